"""What the findings of round 3 were about."""

import random
import time
from fractions import Fraction

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import diffs
from millrace.functions import similarity as sim
from millrace.functions import text
from millrace.functions.stemming import stem
from millrace.llm import near_dedup, token_counts
from millrace.operators import evaluation, stats
from millrace.plans import QUERIES
from tests.llm.brute import near_components

DATA = "/root/testdata/sf0.001"


def test_difference_of_means_keeps_halves_in_any_order(spark):
    rng, rows, want = random.Random(3), [], {}
    for user in range(400):
        n = rng.randint(2, 9)
        a, b = [rng.randint(1, 9999) for _ in range(n)], [rng.randint(1, 9999) for _ in range(n)]
        a[0] += (5 * n - (sum(a) - sum(b))) % (10 * n)  # in hundredths: the means are apart by 5 more than a multiple of 10
        tenths = abs(Fraction(sum(a) - sum(b), 10 * n))
        want[user] = int(tenths + Fraction(1, 2)) * (1 if sum(a) >= sum(b) else -1)
        rows += [(user, side, x / 100) for side, xs in ((0, a), (1, b)) for x in xs]
    rng.shuffle(rows)
    rows += [(-1, 0, 1.0), (-2, 0, None), (-2, 1, 2.0)]
    side = F.col("side")
    found = spark.createDataFrame(rows, "user long, side int, value double").groupBy("user").agg(F.round(stats.difference_of_means(F.col("value"), side == 0, side == 1), 1).alias("d"))
    got = {r["user"]: r["d"] for r in found.collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert {u: round(10 * d) for u, d in got.items()} == want


def test_kernels_hold_few_rows_of_a_batch_as_objects(spark):
    def traced(words):
        import tracemalloc

        tracemalloc.is_tracing() or tracemalloc.start()
        return tracemalloc.get_traced_memory()[1]

    rows = spark.range(4000, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("word"), i, "id")).alias("words"))
    peak = rows.select(sim._by_row(T.LongType(), traced)("words").alias("b")).agg(F.max("b")).first()[0]
    assert peak < 16 << 20  # all rows of a batch are 60 MB of words


def test_stemmed_overlaps_equal_plain_python(spark):
    rng, names = random.Random(8), ["Run", "cats", "nation"]
    lists = [([rng.choice(["run", "running", "cats", "cat", "nation", "b"]) for _ in range(rng.randint(0, 12))], [rng.choice(["cat", "b", "c"]) for _ in range(rng.randint(0, 12))], rng.sample(names, rng.randint(0, 3))) for _ in range(150)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate([*lists, (None, ["a"], None)])], "i int, h array<string>, r array<string>, n array<string>")
    got = df.select("i", sim.stemmed_overlaps(F.col("h"), F.col("r"), 4).alias("s"), sim.stemmed_overlaps(F.col("h"), F.col("r"), 4, F.col("n")).alias("t")).collect()
    for row in got:
        h, r, n = ([stem(w) for w in x or []] for x in ([*lists, (None, ["a"], None)])[row.i])
        wide = r + [w for w in h if w not in r and w in n]
        assert (row.s.m, row.s.h, row.s.r) == (sim.overlap_counts(h, r, 4), len(h), len(r))
        assert (row.t.m, row.t.h, row.t.r) == (sim.overlap_counts(h, wide, 4), len(h), len(wide))


def test_labels_of_long_runs_take_seconds(spark):
    run = "ab" * 60_000
    rows = spark.createDataFrame([(run + "end",), (run + "x #12",)], "t string")
    began = time.time()
    got = [r[0] for r in rows.select(text.clean_label(F.col("t"))).collect()]
    assert time.time() - began < 15 and got == [run + "end", ""]


def test_labels_after_a_match_go_on_inside_a_run(spark):
    rows = spark.createDataFrame([("a#1b.c #2d #3",), ("`x.com`y.io z",), ("a  b  c",)], "t string")
    assert [r[0] for r in rows.select(text.clean_label(F.col("t"))).collect()] == ["", "z", "a b c"]


def test_files_of_a_diff_are_counted_in_one_lateral_join(spark):
    plan = QUERIES["diff_table_functions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1  # the diffs are made once


def test_cider_joins_only_ngrams_of_several_references(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(evaluation, "small", lambda df: joined.append(df) or df)
    pairs = spark.createDataFrame([(1, "a b c d", "a b c e"), (2, "a b x y", "a b x z"), (3, "", "q")], "id int, hyp string, ref string")
    got = {r["id"]: r["cider"] for r in evaluation.cider_variant(pairs, ["id"], "simple").collect()}
    assert sorted(r["df"] for r in joined[0].collect()) == [2, 2, 2] and got[3] == 0 and 0 < got[1] < 10  # a, b, "a b"


def test_near_dedup_deals_anew_only_what_was_not_compared(spark, monkeypatch):
    """Buckets that no component dominates: rows meet again where two such buckets share them, not once for each of their other bands."""
    rng, rows = random.Random(8), []
    for i in range(90):
        rows.append((i, " ".join([f"common{j}" for j in range(40)] + [f"o{i // 2}_{j}" for j in range(30)]) + (f" z{i}" if i % 4 == 1 else "")))
        rows.append((1000 + i, " ".join(rng.choice("abcdefgh") for _ in range(6))))
    dealt, outside = [], near_dedup._links_outside
    monkeypatch.setattr(near_dedup, "_links_outside", lambda members, *rest: dealt.append(members.count()) or outside(members, *rest))
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 6)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(rows, 2, 85)
    assert 0 < dealt[0] < 90 * 8


def test_token_counts_look_up_few_tokens_a_byte():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    rng, path = random.Random(5), public_tokenizers.path("byte_bpe_50k.json")
    count = token_counts.PrefixCounter(path)
    count.numbers = Counted(count.numbers)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["é" * 5, "naïve", "12345", "x_y", "\x00\x01"]
    for word in words:
        spaced = " " + word
        assert count.total(spaced) == len(count.library.encode(spaced, add_special_tokens=False).ids), word
    assert Counted.asked < 3 * sum(len(w.encode()) + 1 for w in words)  # words are 15 letters long, and a last token may begin at each


def test_changed_lines_are_counted_without_patterns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["+", "-", "\n", "+++", "---", "x", "é", "\r", " "]) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", None, "+", "-\n", "\n\n+\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", diffs.added_lines(F.col("t")).alias("a"), diffs.deleted_lines(F.col("t")).alias("d"))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for i, a, d in got.collect():
        lines = None if texts[i] is None else texts[i].split("\n")
        assert (a, d) == (lines and sum(x[:1] == "+" and x[:3] != "+++" for x in lines), lines and sum(x[:1] == "-" and x[:3] != "---" for x in lines))
