"""A left join whose right side may name a key several times, of which the last counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settled import SMALL_ROWS

#: Left rows of a key that one task may get; a key with more is split.
HOT = 1_000_000


def left_join_last(left: DataFrame, right: DataFrame, key: str, order: Column, values: list[str], hot: int = HOT) -> DataFrame:
    """left with the `values` of right's last row by `order` for its key; null where there is none.

    The right side is reduced by one aggregate with map-side combine, so its repeats never meet in a task. A key with more than `hot` left rows is
    split: its left rows are dealt over so many parts, and its one right row goes to each. There are at most rows / hot such keys; they are found by a count with map-side
    combine and broadcast if they are few. Null keys meet nothing. Of right rows that are equal in `order`, the one with the larger values counts. Column names of
    left that occur in `values` are an error.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    last = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(order.alias("_order"), *values)).alias("_last"))
    parts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("_hot", F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    if not parts.limit(1).isEmpty():
        parts = F.broadcast(parts) if parts.count() <= SMALL_ROWS else parts
        dealt = left.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).otherwise(0).cast("int"))
        copied = last.join(parts, F.col("_key") == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).select("_key", "_last", "_copy")
        met = dealt.join(copied, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_copy")), "left")
    else:
        met = left.join(last, F.col(key) == F.col("_key"), "left")
    return met.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("_last")[v].alias(v) for v in values])
