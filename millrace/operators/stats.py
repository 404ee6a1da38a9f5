"""Aggregates that more than one plan uses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts that frontiers are taken of first.
PARTS = 1024


def bucket_counts(df: DataFrame, value: Column, buckets: tuple) -> DataFrame:
    """(bucket, n) for buckets (upper end, name), the last without end. Empty buckets have 0. One aggregate, no join."""
    at, counts, low = F.col("_v"), [], None
    for high, name in buckets:
        inside = at.isNotNull() if low is None else at >= low
        counts.append(F.struct(F.lit(name).alias("bucket"), F.count_if(inside if high is None else inside & (at < high)).alias("n")))
        low = high
    return df.select(value.alias("_v")).agg(F.array(*counts).alias("b")).select(F.inline("b"))


def most_common(df: DataFrame, col: str, order: str, k: int) -> DataFrame:
    """The k commonest values; of equal counts the one seen first."""
    found = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return found.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def most_common_in_group(df: DataFrame, group: str, col: str, order: str) -> DataFrame:
    """(group, col, n): each group's commonest value; of equal counts the one seen first. Two aggregates, both combined map-side."""
    each = df.groupBy(group, col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(F.col(col).alias("v"), "n"), F.struct(F.col("n"), -F.col("_first")))
    return each.groupBy(group).agg(best.alias("b")).select(group, F.col("b.v").alias(col), F.col("b.n").alias("n"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The element at n // 2 of each group's sorted values. Counts by value come first, so a group's copies cost nothing."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy(group).orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("c").over(upto), "all": F.sum("c").over(W.partitionBy(group))})
    return ranked.where(F.col("upto") > F.expr("all div 2")).groupBy(group).agg(F.min(value).cast("long").alias("upper_median"))


def spread(value: Column) -> Column:
    """Sample deviation over the mean; 0 for one value or a mean of 0."""
    mean = F.avg(value)
    return F.when((F.count(value) > 1) & (mean != 0), F.stddev_samp(value) / mean).otherwise(0.0)


def difference_of_means(value: Column, first: Column, second: Column) -> Column:
    """Mean of `value` where `first` holds less that where `second` does, null if either has none. Values count in whole millionths, in decimals, with one division of whole numbers at the
    end: so the order of rows makes no difference, and a half stays a half for what rounds it."""
    sums, counts = [], []
    for side in (first, second):
        sums.append(F.sum(F.when(side, (value.cast("decimal(20,6)") * 1_000_000).cast("decimal(20,0)"))).cast("decimal(26,0)"))
        counts.append(F.count(F.when(side, value)).cast("decimal(11,0)"))
    apart = sums[0] * counts[1] - sums[1] * counts[0]
    return apart.cast("double") / F.nullif(counts[0].cast("double") * counts[1].cast("double") * 1e6, F.lit(0.0))


def ranks_of_differences(pairs: DataFrame, difference: Column) -> DataFrame:
    """One row: n, w_plus, w_minus, ties (sum of t^3 - t) of the signed ranks of differences that are not 0; equal ones share a rank.

    Ranks come from counts by size, so the one window sorts distinct sizes only.
    """
    sizes = pairs.select(difference.alias("d")).where("d IS NOT NULL AND d <> 0").groupBy(F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("p"))
    rank = F.sum("t").over(W.orderBy("a")) - (F.col("t") - 1) / 2.0
    ranked = sizes.withColumn("rank", rank)
    zero = F.lit(0.0)
    return ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("p")), zero).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("t") - F.col("p"))), zero).alias("w_minus"), F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"),
    )


def wilcoxon_p(n: int, w_plus: float, w_minus: float, ties: int) -> float:
    """Two-sided p of the signed-rank test by the normal approximation, corrected for ties; 1 without differences."""
    spread2 = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if n == 0 or spread2 <= 0:
        return 1.0
    return math.erfc(abs(min(w_plus, w_minus) - n * (n + 1) / 4) / math.sqrt(spread2) / math.sqrt(2))


def running_best(df: DataFrame, speed: str, quality: str, order: str) -> DataFrame:
    """The Pareto frontier: rows whose quality beats that of all rows that are as fast or faster; of equal rows the first by `order`."""
    run = [F.desc(speed), F.desc(quality), order]
    # What loses within its part loses over all, so that only the parts' frontiers meet in one task.
    part = W.partitionBy("_part").orderBy(*run).rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS))).withColumn("_best", F.max(quality).over(part))
    df = own.where(F.col("_best").isNull() | (F.col(quality) > F.col("_best"))).drop("_best", "_part")
    before = W.orderBy(*run).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(quality).over(before)).where(F.col("_best").isNull() | (F.col(quality) > F.col("_best"))).drop("_best")


def extremes(df: DataFrame, name: str, value: str) -> DataFrame:
    """One row: max_name, max_value, min_name, min_value, mean, n; of equal values the smallest name. Nulls count for nothing."""
    known = df.where(F.col(value).isNotNull())
    low = F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return known.agg(high.alias("h"), low.alias("l"), F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("h.n").alias("max_name"), (-F.col("h.v")).alias("max_value"), F.col("l.n").alias("min_name"), F.col("l.v").alias("min_value"), "mean", "n")


def ratio_of_sums(a: Column, b: Column) -> Column:
    return F.sum(a) / F.greatest(F.sum(b), F.lit(1e-9))


def or_one(c: Column) -> Column:
    """null and 0 count as 1."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
