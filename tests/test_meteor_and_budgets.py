"""The synonym stage of METEOR, and cuts to a budget of tokens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import budgets, similarity
from millrace.functions.stemming import stem
from millrace.operators import evaluation


def slow_score(hyp, ref, synsets):
    """Stage by stage over all pairs of places, from the last ones."""
    left_h, left_r, pairs = set(range(len(hyp))), set(range(len(ref))), []
    for same in (lambda a, b: a == b, lambda a, b: stem(a) == stem(b), lambda a, b: bool(set(synsets.get(a, ())) & set(synsets.get(b, ())))):
        for i in sorted(left_h, reverse=True):
            for j in sorted(left_r, reverse=True):
                if same(hyp[i], ref[j]):
                    pairs.append((i, j))
                    left_h.discard(i)
                    left_r.discard(j)
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(hyp), len(pairs) / len(ref)
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_stages_in_turn():
    rng = random.Random(7)
    words = "fix fixes fixed repair mend bug bugs error fault add adds insert".split()
    synsets = {"fix": ["1"], "repair": ["1", "2"], "mend": ["2"], "bug": ["3"], "error": ["3", "4"], "fault": ["4"], "add": ["5"], "insert": ["5"]}
    for _ in range(2000):
        hyp, ref = (rng.choices(words, k=rng.randint(0, 7)) for _ in range(2))
        assert math.isclose(similarity.meteor_score(hyp, ref, synsets=synsets), slow_score(hyp, ref, synsets)), (hyp, ref)
        assert math.isclose(similarity.meteor_score(hyp, ref), slow_score(hyp, ref, {})), (hyp, ref)


@pytest.mark.parametrize("chars", [1 << 20, 0])
def test_synonyms_by_broadcast_and_by_join(spark, monkeypatch, chars):
    monkeypatch.setattr(evaluation, "SYNONYM_CHARS", chars)
    pairs = spark.createDataFrame([(1, "mend the bug", "repair a bug"), (None, "add it", "insert it"), (3, "", "x"), (4, "x", "y")], "i int, ref string, hyp string")
    table = spark.createDataFrame([("mend", 2), ("repair", 1), ("repair", 2), ("add", 5), ("insert", 5), (None, 1), ("x", None)], "w string, s int")
    sets = {"mend": ["2"], "repair": ["1", "2"], "add": ["5"], "insert": ["5"]}
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = {r.i: r.meteor for r in evaluation.meteor_by_synonyms(pairs, ["i"], tokens, table).collect()}
    for i, ref, hyp in [tuple(r) for r in pairs.collect()]:
        assert math.isclose(got[i], slow_score(hyp.split(), ref.split(), sets) if ref and hyp else 0.0)
    without = {r.i: r.meteor for r in evaluation.meteor_by_synonyms(pairs, ["i"], tokens, table.limit(0)).collect()}
    assert without[1] < got[1] and set(without) == set(got)


def test_budgets_equal_the_library(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = budgets._tokenizer(path)
    texts = ["", "one", "One two, three four.", "naïve 中文 😀😀 text", "x" * 3000, "a  b\n\n c " * 50, "<|endoftext|> plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for budget in (0, 1, 2, 3, 5, 8, 13, 40, 10_000):
        got = {r.i: r.c for r in df.select("i", budgets.cut_to_tokens(F.col("t"), budget, path).alias("c")).collect()}
        for i, t in enumerate(texts):
            ids = library.encode(t, add_special_tokens=False).ids
            want = t if len(ids) <= budget else library.decode(ids[:budget], skip_special_tokens=False)
            assert (got[i].text, got[i].n_tokens, got[i].cut) == (want, len(ids), len(ids) > budget), (t, budget)
        assert got[len(texts)].text is None
