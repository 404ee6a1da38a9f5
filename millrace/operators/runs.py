"""Runs and their records: keep-first, common ids, resume, grids, batches."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import running


def _keep(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    row = pick(F.struct(*df.columns), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(row).select("_r.*")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes first. An aggregate, so copies of a key are reduced before the shuffle."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def common_ids(df: DataFrame, id_col: str, mode_col: str, order: str) -> DataFrame:
    """Ids that occur under all modes, in the order in which they come first."""
    modes = df.select(F.countDistinct(mode_col).alias("_m"))
    each = df.groupBy(id_col).agg(F.countDistinct(mode_col).alias("_k"), F.min(order).alias("first_id"))
    return each.join(F.broadcast(modes), F.col("_k") == F.col("_m")).select(id_col, "first_id").orderBy("first_id")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values, a row each; a grid is made by hand and small."""
    return spark.createDataFrame(list(itertools.product(*axes.values())), list(axes))


def first_of_sources(*frames: DataFrame, key: str) -> DataFrame:
    """Rows of several sources, the first source that has a key winning."""
    ranked = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    every = ranked[0]
    for f in ranked[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return keep_first(every, [key], "_src").drop("_src")


def batches(df: DataFrame, group: str, length: str, order: str, size: int) -> DataFrame:
    """(group, batch, n, longest, padding): items sorted by length in batches of `size`; padding is what is missing to the longest. A group may be any part of the rows."""
    cut = running(df.select(group, length, order), [group], [F.col(length), F.col(order)]).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))
    waste = (F.max(length) * F.count(F.lit(1)) - F.sum(length)).alias("padding")
    return cut.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), waste)


def effective_tokens(tokens: Column, cap: int, chars: Column, overhead: int) -> Column:
    """Tokens that a text cut to `cap` characters takes, with what a prompt adds."""
    cut = F.greatest(F.floor(tokens * cap / F.greatest(chars, F.lit(1))), F.lit(1))
    return (F.when(chars > cap, cut).otherwise(tokens) + overhead).cast("long")
