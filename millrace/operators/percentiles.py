"""Exact percentiles of many columns at once, by histograms that are refined where a wanted rank lies.

The first pass finds each group's and column's count, least and largest value. Each further pass cuts the intervals that hold
wanted ranks into bins and counts them, with map-side combine, so what is shuffled and held is a bin's count, never its
values; the bin that holds a rank is the interval of the next pass. Intervals of few rows are finished by counting their
values. Order is that of the values themselves, as bins are monotone in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settled import discard, settled, small

#: Bins of an interval in one pass; rows up to which an interval's values are counted one by one.
BINS, FEW = 1024, 20_000


def _wanted(n: Column, ps: list[float], upper: bool) -> Column:
    """The ranks from 0 that percentiles of n values need; those of the upper median too."""
    at = [F.array(*[F.floor(F.lit(p) * (n - 1)), F.least(F.floor(F.lit(p) * (n - 1)) + 1, n - 1)]) for p in ps]
    return F.array_distinct(F.flatten(F.array(*at, *[F.array(F.floor(n / 2))] * upper)))


def _long(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """(_g0.., _col, _v): a row per finite value."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    rows = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], each.alias("_x"))
    finite = F.col("_x.v").isNotNull() & ~F.isnan("_x.v") & (F.abs("_x.v") != float("inf"))
    return rows.where(finite).select(*[f"_g{i}" for i in range(len(groups))], F.col("_x.c").alias("_col"), F.col("_x.v").alias("_v"))


def _same(keys: list[str], a: str, b: str) -> Column:
    """Equal keys; null groups are groups."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def exact_percentiles(df: DataFrame, values: list[str], ps: list[float], groups: list[str] | None = None, upper_median: bool = False) -> DataFrame:
    """One row per group and column: groups, `column`, n, least, largest, mean, `percentiles` (array, by linear interpolation at p (n - 1)),
    and with `upper_median` the value at n // 2.

    Nulls, NaN and infinite values count for nothing; a group and column without others has no row. Null groups are groups. Ties, negative values and any
    column names are fine; values are compared as doubles. No task holds more of a group than BINS counts or the counts of FEW values.
    """
    groups = groups or []
    g = [f"_g{i}" for i in range(len(groups))]
    keys = [*g, "_col"]
    rows = _long(df, groups, values)
    total = settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("largest"), F.avg("_v").alias("mean")))
    wanted = total.select(*keys, F.explode(_wanted(F.col("n"), ps, upper_median)).alias("rank"), F.col("least").alias("lo"), F.col("largest").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    ranks = _refined(rows, keys, wanted)
    at = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    n, value = F.col("n"), lambda i: F.element_at("at", i)
    made = []
    for p in ps:
        place = F.lit(p) * (n - 1)
        low = F.floor(place)
        made.append(value(low) + (place - low) * (value(F.least(low + 1, n - 1)) - value(low)))
    names = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t._col") + 1)
    out = total.alias("t").join(at.alias("a"), _same(keys, "t", "a"))
    return out.select(*[F.col(f"t._g{i}").alias(name) for i, name in enumerate(groups)], names.alias("column"), "n", "least", "largest", "mean", F.array(*made).alias("percentiles"), *[value(F.floor(n / 2)).alias("upper_median")] * upper_median)


def _refined(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, rank, value, below) for ranks whose intervals are known: the value at the rank, and how many values are smaller. rows: keys, _v; wanted: keys, rank, lo, hi, below, inside."""
    told = [*keys, "rank", F.col("lo").alias("value"), "below"]
    open_, found = settled(wanted), []
    while True:
        found.append(open_.where("lo = hi").select(*told))
        wide, narrow = (open_.where(f"lo < hi AND inside {c} {FEW}") for c in (">", "<="))
        if wide.isEmpty():
            break
        held = _counted(rows, keys, wide, F.floor(_share(F.col("_v"), F.col("_at.lo"), F.col("_at.hi")) * BINS).cast("int"))
        open_ = settled(_placed(held, keys, wide).union(narrow))
    # The rest lies in intervals of few rows: their values are the bins.
    if not narrow.isEmpty():
        found.append(_placed(_counted(rows, keys, narrow, F.col("_v")), keys, narrow).select(*told))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def values_at(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, tuple[float, int]]:
    """rank (from 0, in rising order) -> (the value there, how many values are smaller); ranks beyond the end are left out. Nulls and values that are not finite don't count."""
    rows = df.select(F.lit(0).alias("_col"), value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").where(F.abs("_v") != float("inf"))
    (n, low, high) = rows.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    inside = sorted({r for r in ranks if 0 <= r < n})
    if not inside:
        return {}
    wanted = df.sparkSession.createDataFrame([(0, r, low, high, 0, n) for r in inside], "_col int, rank bigint, lo double, hi double, below bigint, inside bigint")
    return {r["rank"]: (r["value"], r["below"]) for r in _refined(rows, ["_col"], wanted).collect()}


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where v lies from lo to hi, below 1; halves, so that no difference overflows. Monotone in v."""
    span = hi / 2 - lo / 2
    return F.least(F.coalesce((v / 2 - lo / 2) / F.nullif(span, F.lit(0.0)), F.lit(0.0)), F.lit(1 - 2**-53))


def _counted(rows: DataFrame, keys: list[str], intervals: DataFrame, bin_: Column) -> DataFrame:
    """(keys, lo, bin, c, least, most) of the values in the intervals. Intervals of a key don't overlap, so each value is in one at most."""
    each = settled(intervals.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("_in")))
    met = rows.alias("r").join(small(each).alias("i"), _same(keys, "r", "i")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", F.try_element_at(F.filter("_in", lambda x: (x["lo"] <= F.col("_v")) & (F.col("_v") <= x["hi"])), F.lit(1)).alias("_at"))
    inside = met.where("_at IS NOT NULL").select(*keys, F.col("_at.lo").alias("lo"), bin_.alias("bin"), "_v")
    return settled(inside.groupBy(*keys, "lo", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most")))


def _placed(bins: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The ranks with the bin that holds them as their interval."""
    before = F.coalesce(F.sum("c").over(W.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = bins.withColumn("before", before)
    at = F.col("w.rank") - F.col("w.below")
    met = wanted.alias("w").join(ranked.alias("b"), _same([*keys, "lo"], "w", "b") & (F.col("b.before") <= at) & (at < F.col("b.before") + F.col("b.c")))
    return met.select(*[F.col(f"w.{k}").alias(k) for k in keys], F.col("w.rank").alias("rank"), F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), (F.col("w.below") + F.col("b.before")).alias("below"), F.col("b.c").alias("inside"))
