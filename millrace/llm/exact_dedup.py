"""Exact deduplication with a heavy-hitter split.

Digests that fill a fixed share of all rows would each meet in one task of a shuffle. A Misra-Gries pass finds the
candidates (at most `counters` a partition, merged by addition), an exact count verifies them, and the winners, of which
there can be no more than 1/heavy_share, are broadcast: their rows are settled where they lie. All other digests take the
ordinary way, an aggregate with map-side combine and a join that AQE can split.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table


def _shrink(held: Counter, counters: int) -> Counter:
    """Merging step of Misra-Gries: the (counters+1)-th largest count is taken from all, and what falls to 0 goes."""
    if len(held) <= counters:
        return held
    cut = sorted(held.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in held.items() if v > cut})


def misra_gries(df: DataFrame, key: str, counters: int) -> DataFrame:
    """(key, seen): counters of every partition, added up. Each is too low by less than rows / (counters + 1) in all."""

    def scan(batches):
        held: Counter = Counter()
        for batch in batches:
            held.update(batch[key].value_counts().to_dict())
            held = _shrink(held, counters)
        yield pd.DataFrame({key: pd.Series(list(held.keys()), dtype=object), "seen": pd.Series(list(held.values()), dtype="int64")})

    kind = df.schema[key].dataType.simpleString()
    found = df.select(key).mapInPandas(scan, f"{key} {kind}, seen bigint")
    return found.groupBy(key).agg(F.sum("seen").alias("seen"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256, heavy_share: float = 1 / 128) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest id stays. Defined cases: an id names a document, so repeated rows with the largest id are all kept; null ids
    never win, and rows without id are kept only where no row of their group has one. Empty tables give no rows; columns
    other than id and text are not read.
    """
    if not 1 / (counters + 1) < heavy_share <= 1:
        raise ValueError("heavy_share must be above 1 / (counters + 1)")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = settle(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("digest")))
    total = rows.count()

    floor = total * (heavy_share - 1 / (counters + 1))  # a digest with heavy_share of the rows keeps at least this count
    likely = misra_gries(rows, "digest", counters).where(F.col("seen") >= floor).select("digest")
    groups = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = settle(rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(*groups).where(F.col("group_size") >= heavy_share * total))

    hot = rows.join(F.broadcast(heavy), "digest")
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    cold = cold.join(cold.groupBy("digest").agg(*groups).where("group_size > 1"), "digest", "left")
    cold = cold.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
    both = hot.select("id", "keep_id", "group_size", "digest").unionByName(cold.select("id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest"))
    return both.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
