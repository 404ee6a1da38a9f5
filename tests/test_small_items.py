"""Corpus BLEU-CODE, CIDEr's inputs, prompts from summaries, quoted reasons, lists of ids, layered configs, answers from labels."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import building, evaluation, selection, stats
from millrace.plans import QUERIES, config
from tests.oracle import DATA


def test_corpus_bleu_code_adds_up(spark):
    from millrace.plans import metrics

    each = metrics._code_counts(spark, DATA).collect()
    for r in QUERIES["bleu_code_corpus"](spark, DATA).collect():
        own = [x for x in each if x.conv_id % 2 == r.mode]
        m = [sum(x[f"m{n}"] for x in own) for n in range(1, 5)]
        t = [sum(max(x[f"t{n}"], 1) for x in own) for n in range(1, 5)]
        h, ref = sum(x.h for x in own), sum(x.r for x in own)
        mean = math.exp(sum(math.log((a or 0.1) / b) for a, b in zip(m, t)) / 4)
        want = 0.0 if not m[0] else mean * (1 if h > ref else math.exp(1 - ref / h))
        assert (r.m1, r.t1, r.m4, r.t4) == (m[0], t[0], m[3], t[3]) and math.isclose(r.bleu_code, want, abs_tol=1e-6)


def test_cider_inputs(spark):
    pairs = spark.createDataFrame([(1, "fix the bug", "noise <MSG>fix the bug</MSG> more"), (2, "add a test", "add tests!"), (3, "", "x"), (4, "x y", "")], "i int, ref string, hyp string")
    got = {v: {r.i: r.cider for r in evaluation.cider_variant(pairs, ["i"], v).collect()} for v in evaluation.VARIANTS}
    assert all(set(x) == {1, 2, 3, 4} and x[3] == x[4] == 0 for x in got.values())
    assert math.isclose(got["tagged"][1], 10) and 0 < got["evaluated"][1] < 10 and 0 < got["simple"][2] < 10
    assert evaluation.cider_variant(pairs.limit(0), ["i"], "simple").count() == 0


def picked(rows, quota):
    """The rule as it is told, row by row."""
    out = []
    for s in sorted({r[1] for r in rows}, key=repr):
        chosen, repos = [], set()
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[0])):
            if len(chosen) < quota and (r[2] not in repos or len(repos) >= quota // 2):
                chosen.append(r[0])
                repos.add(r[2])
        out += [(i, k + 1) for k, i in enumerate(chosen)]
    return sorted(out)


@pytest.mark.parametrize("quota", [1, 2, 5, 9])
def test_quota_pick_row_by_row(spark, quota):
    import random

    rng = random.Random(quota)
    rows = [(i, rng.choice([1, 2, None]), rng.choice(["a", "b", "c", None] if i % 4 else ["a"]), rng.randint(0, 9)) for i in range(120)] + [(500 + i, 3, "one", i) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, s int, repo string, score int")
    got = sorted((r.id, r.k) for r in selection.quota_pick(df, "s", "repo", "score", "id", F.lit(quota)).collect())
    assert got == picked(rows, quota)


def test_extremes(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 0.5), ("d", None)], "n string, v double")
    assert tuple(stats.extremes(df, "n", "v").first()) == ("a", 2.0, "c", 0.5, 1.5, 3)


def test_prompts_from_summaries(spark):
    rows = [("t", 2, "b.py", "second"), ("t", 1, "a.py", "first")]
    block = building.summaries_block(spark.createDataFrame(rows, "task string, i int, f string, s string"), "task", "i", "f", "s")
    (r,) = block.select(building.summary_messages(F.col("block"), F.lit("be brief")).alias("m")).collect()
    assert [x.role for x in r.m] == ["system", "user"] and r.m[0].content == "be brief"
    assert r.m[1].content.endswith("## File Summaries:\n\n### a.py\nfirst\n\n### b.py\nsecond")


def test_reasons_quote_what_was_lost(spark):
    said = ["Repair the scanner", "", None, "   \n\t", "it's \"two\"\x00\xa0é"]
    df = spark.createDataFrame([(x,) for x in said], "m string")
    label, reason = building.label_gates(F.col("m"))
    got = df.select(label.alias("label"), reason.alias("reason"), building.quoted("m").alias("q")).collect()
    assert got[0].label and got[0].reason is None
    assert [r.reason for r in got[1:3]] == ["empty after clean_label       | was: ''"] * 2
    assert got[3].reason == f"empty after clean_label       | was: {said[3]!r}"
    assert [r.q for r in got] == [None if x is None else repr(x) for x in said]


def test_allow_list(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, _id string")
    ids = spark.createDataFrame([(2,), (2,), (None,), (7,)], "x int")
    assert sorted(r[1] for r in building.allowed(df, "id", ids).collect()) == ["b", "c"]
    assert building.allowed(df, "id", ids.limit(0)).isEmpty()


def test_layers_and_validation():
    got = config.layered({"a": {"x": 1, "y": 2}, "modes": ["m"], "n": 1}, {"a": {"y": 3}}, {"n": 5, "modes": None})
    assert got == {"a": {"x": 1, "y": 3}, "modes": ["m"], "n": 5}
    good = {"modes": ["m"], "devices": ["cpu"], "input": "in"}
    assert config.validated(good, ("m", "k")) == good
    for bad, what in (({"modes": ["z"]}, "no such mode: z"), ({"devices": []}, "no device"), ({"devices": ["cuda:0"]}, "no accelerator"), ({"input": ""}, "no input")):
        with pytest.raises(ValueError, match=what):
            config.validated(good | bad, ("m", "k"))
    with pytest.raises(ValueError, match="there are 2"):
        config.validated(good | {"devices": ["cuda:1", "cuda:2"]}, ("m",), accelerators=2)


def test_answers_from_labels_and_the_prompt_mask(spark):
    m = "m array<struct<role string, content string>>, label string"
    df = spark.createDataFrame([([("user", "q"), ("assistant", "a")], "L"), ([("user", "q")], "L"), ([], None)], m)
    got = building.split_at_answer(df, "m", "label").collect()
    assert [(len(r.prompt), r.answer) for r in got] == [(1, "a"), (1, "L"), (0, None)]
    assert [r.answer for r in building.split_at_answer(df, "m").collect()] == ["a", None, None]
    ids = spark.createDataFrame([([1, 2], [1, 2, 3, 4, 5]), ([], [7]), ([1, 2, 3, 4], [1, 2, 3, 4])], "p array<int>, all array<int>")
    told = ids.select(*[c.alias(n) for c, n in zip(building.pad_block(F.col("all"), F.col("p"), 4, 0), ("ids", "labels"))]).collect()
    no = building.NO_LOSS
    assert [(r.ids, r.labels) for r in told] == [([1, 2, 3, 4, 5, 0, 0, 0], [no, no, 3, 4, 5, no, no, no]), ([7, 0, 0, 0], [7, no, no, no]), ([1, 2, 3, 4], [no] * 4)]


def test_nearest_takes_turns(spark):
    import random

    rng = random.Random(11)
    rows = [(i, rng.randint(1, 40)) for i in range(150)] + [(900, None)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(4)
    for targets, k in (([1, 3, 5, 10, 12, 30], 4), ([20, 21, 22], 9), ([500], 3)):
        taken, want = set(), []
        for t in sorted(targets):
            fit = [(abs(v - t), -v, i) for i, v in rows if v is not None and i not in taken and (v == t if t <= 5 else abs(v - t) <= max(0.3 * t, 2))]
            for n, (_, _, i) in enumerate(sorted(fit)[:k], 1):
                taken.add(i)
                want.append((t, i, n))
        assert sorted(map(tuple, selection.nearest(df, "v", "i", targets, k).collect())) == sorted(want)
    assert selection.nearest(df.limit(0), "v", "i", [1], 2).count() == 0
