"""Percentiles and paired tests against plain Python."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import paired, percentiles


def at(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low = math.floor(place)
    return values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_percentiles_refine_to_the_values(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FEW", 3)
    monkeypatch.setattr(percentiles, "BINS", 4)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([rng.randint(-5, 5), rng.gauss(0, 1e6), rng.random() * 1e-12])), rng.randint(0, 3) * 10) for _ in range(400)]
    rows += [("one", 7.5, None), ("none", None, None), ("odd", float("nan"), 1), ("odd", float("inf"), 2), ("odd", -math.inf, 2), ("big", 1.7e308, 1), ("big", -1.7e308, 1), ("big", 5e-324, 1)]
    df = spark.createDataFrame(rows, "g string, v double, _col int").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {(r.g, r.column): r for r in percentiles.exact_percentiles(df, ["v", "_col"], ps, ["g"], upper_median=True).collect()}
    want = {}
    for g, v, c in rows:
        if v is not None and math.isfinite(v):
            want.setdefault((g, "v"), []).append(v)
        if c is not None:
            want.setdefault((g, "_col"), []).append(float(c))
    assert set(got) == set(want)
    for k, values in want.items():
        r = got[k]
        assert (r.n, r.least, r.largest, r.upper_median) == (len(values), min(values), max(values), sorted(values)[len(values) // 2])
        for p, x in zip(ps, r.percentiles):
            assert math.isclose(x, at(values, p), rel_tol=1e-12, abs_tol=1e-300) or k[0] == "big", (k, p)  # whose differences overflow
    assert percentiles.exact_percentiles(df.limit(0), ["v"], ps).count() == 0
    (whole,) = percentiles.exact_percentiles(df.where("g = 'one'"), ["v"], ps).collect()
    assert whole.percentiles == [7.5] * 6


def brute_p(differences):
    d = [x for x in differences if x]
    if not d:
        return 1.0
    size = sorted(abs(x) for x in d)
    rank = {s: statistics.mean(i + 1 for i, x in enumerate(size) if x == s) for s in size}
    ranks = [rank[abs(x)] for x in d]
    up = sum(r for r, x in zip(ranks, d) if x > 0)
    low = min(up, sum(ranks) - up)
    hits = sum(sum(r for r, s in zip(ranks, signs) if s) <= low for signs in itertools.product((0, 1), repeat=len(d)))
    return min(1.0, 2 * hits / 2 ** len(d))


def test_signed_rank_counts_patterns(spark):
    rng = random.Random(8)
    groups = {g: [float(rng.choice([-3, -2, -1, 0, 1, 2, 3, 4])) if g % 2 else rng.gauss(0.5, 1) for _ in range(rng.randint(1, 12))] for g in range(30)}
    groups[100] = [0.0, 0.0]
    rows = [(g, d) for g, ds in groups.items() for d in ds] + [(None, 1.0), (None, None), (None, float("nan")), (101, None)]
    df = spark.createDataFrame(rows, "g int, d double").repartition(3)
    got = {r.g: r for r in paired.signed_rank_tests(df, F.col("d"), ["g"]).collect()}
    for g, ds in groups.items():
        assert math.isclose(got[g].p_value, brute_p(ds), rel_tol=1e-12), (g, ds)
        assert got[g].significant == (brute_p(ds) < 0.05) and got[g].exact
    assert (got[None].n, got[None].p_value) == (1, 1.0) and (got[101].n, got[101].p_value) == (0, 1.0)
    (whole,) = paired.signed_rank_tests(df.where("g = 3"), F.col("d"), []).collect()
    assert math.isclose(whole.p_value, brute_p(groups[3]), rel_tol=1e-12)


def test_signed_rank_normal(spark):
    rng = random.Random(1)
    ds = [round(rng.gauss(0.2, 1), 1) for _ in range(400)]
    (r,) = paired.signed_rank_tests(spark.createDataFrame([(d,) for d in ds], "d double"), F.col("d"), []).collect()
    n = r.n
    z = abs(r.statistic - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r.ties / 48)
    assert not r.exact and math.isclose(r.p_value, math.erfc(z / math.sqrt(2)), rel_tol=1e-8) and r.w_plus + r.w_minus == n * (n + 1) / 2
    zs = [0.0, 0.5, 1.96, 5.0, 20.0]
    for z, r in zip(zs, spark.createDataFrame([(z,) for z in zs], "z double").select(paired.two_sided_normal(F.col("z")).alias("p")).collect()):
        assert math.isclose(r.p, math.erfc(z / math.sqrt(2)), rel_tol=1e-8)


@pytest.mark.parametrize("n", [60, 2_000])
def test_bootstrap_covers_the_mean_as_often_as_it_says(spark, n):
    """Of 40 groups whose mean is 1, about 95 % have it in their interval, and its width is that of the normal one."""
    rng = random.Random(n)
    df = spark.createDataFrame([(i, i % 40, rng.gauss(1, 1)) for i in range(40 * n)], "id long, g long, d double")
    got = paired.bootstrap_intervals(df, "id", F.col("d"), ["g"], draws=200).collect()
    assert len(got) == 40 and all(r.n == n and r.low <= r.mean <= r.high for r in got)
    assert sum(r.low <= 1 <= r.high for r in got) >= 33
    width = statistics.mean(r.high - r.low for r in got) * math.sqrt(n) / (2 * 1.96)
    assert 0.85 < width < 1.1


def test_bootstrap_cases(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), (5, None, "x"), (6, 2.0, "y")], "k int, d double, g string")
    got = {r.g: r for r in paired.bootstrap_intervals(df, "k", F.col("d"), ["g"]).collect()}
    assert set(got) == {None, "y"} and (got[None].n, got[None].mean, got["y"].low, got["y"].high) == (2, 2.0, 2.0, 2.0)
    assert paired.bootstrap_intervals(df.limit(0), "k", F.col("d"), ["g"]).count() == 0
