"""Tests and intervals of paired differences, per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running

#: Up to so many differences the distribution is counted out; beyond, it is taken as normal.
EXACT = 25
#: Steps of Simpson's rule over STRETCH deviations, or STRETCH / z beyond one.
STEPS, STRETCH = 1200, 24.0
#: Hash blocks whose sums are resampled. Groups of fewer rows are in effect resampled row by row.
BLOCKS = 4096


def _exact_p(ranks: Column, smaller: Column) -> Column:
    """Two-sided p: the share of sign patterns whose smaller rank sum is no larger. ranks: doubled mid-ranks, so whole numbers.

    The counts of patterns by their sum of positive ranks grow by one rank at a time: a pattern's rank is left out or taken.
    """
    start = F.array(F.lit(1.0))
    grow = lambda s, r: F.zip_with(F.concat(s, F.array_repeat(F.lit(0.0), r)), F.concat(F.array_repeat(F.lit(0.0), r), s), lambda a, b: a + b)
    counts = F.aggregate(ranks, start, grow)
    low = F.aggregate(F.slice(counts, F.lit(1), (2 * smaller).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), F.size(ranks)))


def two_sided_normal(z: Column) -> Column:
    """The chance that a normal variable lies at least z from its mean, by Simpson's rule over the tail, so that small chances are right in their first digits too."""
    h = F.lit(STRETCH / STEPS) / F.greatest(F.lit(1.0), z)  # the tail falls off the faster the larger z is
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    term = lambda a, i: a + weight(i) * F.exp(-(z + i * h) * (z + i * h) / 2)
    tail = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), term) * h / (3 * math.sqrt(2 * math.pi))
    return F.least(F.lit(1.0), 2 * tail)


def signed_rank_tests(pairs: DataFrame, difference: Column, groups: list[str], alpha: float = 0.05) -> DataFrame:
    """Wilcoxon's signed-rank test in each group: groups, n (differences that are not 0), w_plus, w_minus, statistic (the smaller), ties (sum of t^3 - t),
    exact (whether p is counted out), p_value, significant.

    Equal sizes share their mean rank. With n up to EXACT the p value counts all sign patterns of the ranks at hand, ties included; beyond, it is normal with
    the variance corrected for ties. Null and NaN differences and zeros are left out; a group that has only such has n = 0 and p = 1; null groups are groups.
    Ranks are running counts over sorted ranges of distinct sizes, so a group may have any number of them.
    """
    g = [f"_key{i}" for i in range(len(groups))]
    rows = pairs.select(*[F.col(c).alias(k) for c, k in zip(groups, g, strict=True)], difference.cast("double").alias("d"))
    told = rows.where("d IS NOT NULL AND NOT isnan(d) AND d <> 0")
    sizes = told.groupBy(*g, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running(sizes, g, [F.col("size")], place="_place", sums={"upto": F.col("t")})
    rank = F.col("upto") - (F.col("t") - 1) / 2.0
    t = F.col("t")
    parts = ranked.withColumn("rank", rank).groupBy(*g).agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (t - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"),
        # At most EXACT of the smallest sizes are kept: a group with more differences doesn't need them.
        F.collect_list(F.when(F.col("_place") <= EXACT, F.struct((2 * F.col("rank")).cast("int").alias("r"), F.least(t, F.lit(EXACT + 1)).cast("int").alias("t")))).alias("kept"),
    )
    every = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_rows"))
    same = F.lit(True)
    for k in g:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}"))
    both = every.alias("e").join(parts.alias("p"), same, "left") if g else every.crossJoin(parts.alias("p"))  # one row each
    side = "e." if g else ""
    zero = F.lit(0.0)
    out = both.select(*[F.col(side + k).alias(c) for c, k in zip(groups, g, strict=True)], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", zero).alias("w_plus"), F.coalesce("w_minus", zero).alias("w_minus"), F.coalesce("ties", F.lit(0)).alias("ties"), "kept")
    n = F.col("n").cast("double")
    smaller = F.least("w_plus", "w_minus")
    ranks = F.flatten(F.transform("kept", lambda x: F.array_repeat(x["r"], x["t"])))
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    normal = two_sided_normal(F.abs(smaller - n * (n + 1) / 4) / F.sqrt(variance))
    p = F.when(F.col("n") == 0, 1.0).when(F.col("n") <= EXACT, _exact_p(ranks, smaller)).when(variance > 0, normal).otherwise(1.0)
    return out.withColumns({"statistic": smaller, "exact": F.col("n") <= EXACT, "p_value": p}).withColumn("significant", F.col("p_value") < alpha).drop("kept")


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 from the MD5 of the parts' text, which any SQL engine can repeat."""
    hexed = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)
    return (F.conv(hexed, 16, 10).cast("long") + 0.5) / float(1 << 48)


def poisson_steps() -> list[float]:
    """P(number <= k) of a Poisson variable of mean 1, up to what a double can tell from 1."""
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


def _poisson(chance: Column) -> Column:
    """The Poisson number of mean 1 at a chance."""
    return sum((F.when(chance > s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))


def bootstrap_intervals(pairs: DataFrame, key: str, difference: Column, groups: list[str], draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """The mean paired difference of each group with a percentile interval of bootstrap means: groups, n, mean, low, high.

    Rows fall into BLOCKS blocks by a hash of their key, and what is resampled are the blocks' sums and counts: each block counts in a draw as often as a Poisson
    number of mean 1 that its hash and the draw's give. So the rows are read once and combined map-side, and the draws cost BLOCKS times `draws` per
    group whatever the number of rows; reruns agree. Rows of one key stay together. Null differences are left out, null keys are one key, null groups are
    groups; a group with one block has an interval of no width.
    """
    rows = pairs.select(*groups, F.col(key).alias("_k"), difference.cast("double").alias("_d")).where("_d IS NOT NULL AND NOT isnan(_d)")
    block = F.floor(_chance(F.col("_k"), F.lit(seed)) * BLOCKS).cast("int")
    sums = rows.groupBy(*groups, block.alias("_b")).agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_n"))
    drawn = sums.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_times", _poisson(_chance(F.col("_b"), F.col("_draw"), F.lit(seed))))
    means = drawn.groupBy(*groups, "_draw").agg(F.sum(F.when(F.col("_draw") == 0, F.col("_s"))).alias("_s0"), F.sum(F.when(F.col("_draw") == 0, F.col("_n"))).alias("_n0"), (F.sum(F.col("_s") * F.col("_times")) / F.nullif(F.sum(F.col("_n") * F.col("_times")), F.lit(0))).alias("_mean"))
    edges = F.percentile("_mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))  # of at most `draws` numbers
    out = means.groupBy(*groups).agg(F.max("_n0").alias("n"), F.max("_s0").alias("_s"), edges.alias("_e"))
    return out.select(*groups, "n", (F.col("_s") / F.col("n")).alias("mean"), F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))
