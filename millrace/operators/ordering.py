"""Order over whole frames without a window that puts all rows, or all of a large group, in one task.

Rows are sorted into ranges by group and order, each row knows its place in its range, and a small table carries on what
the ranges before it add. A range holds its part of the rows, whatever the number of groups: a group may span many ranges.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to so many ranges and groups their table is broadcast; beyond, it is joined by shuffle.
SMALL = 50_000
_BITS = 33  # of the place in a partition, in monotonically_increasing_id


def running(df: DataFrame, group: list[str], order: list[Column], place: str = "place", sums: dict[str, Column] | None = None) -> DataFrame:
    """df with `place`, the rank from 1 in its group (none: over all) by `order`, and running `sums`, each row's own included.

    `order` must leave no ties. The sorted frame is persisted, on disk where memory is short, since the table of ranges is taken from the
    very ranges that are ranked. Null groups are groups.
    """
    sums = sums or {}
    values = {f"_s{i}": c for i, c in enumerate(sums.values())}
    ranged = (df.withColumns(values) if values else df).repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*group, *order)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_id", _BITS), "_row": F.col("_id").bitwiseAND((1 << _BITS) - 1)}).drop("_id").persist(StorageLevel.MEMORY_AND_DISK)
    totals = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), *[F.sum(s).alias(s) for s in values])
    before = (W.partitionBy(*group) if group else W.partitionBy()).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_b{s}") for s in values],
    )
    offsets = offsets.persist(StorageLevel.MEMORY_AND_DISK)
    side = F.broadcast(offsets) if offsets.count() <= SMALL else offsets
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(side, same)
    if values:
        within = W.partitionBy("_part", *group).orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumns({name: F.col(f"_b{s}") + F.sum(s).over(within) for name, s in zip(sums, values, strict=True)})
    return out.withColumn(place, F.col("_row") + F.col("_shift")).select(*[c for c in df.columns if c not in (place, *sums)], place, *sums)
