"""Mixing sources to target weights, with hash thresholds instead of sorts.

Every document has a hash of `LEVELS * BITS` bits. A source that is to give `target` words gives each document
floor(target / size) whole times, and for the rest takes the documents whose hash lies below a threshold. The threshold
is found by histograms: words summed by source and leading hash bits, the bucket in which the running sum passes the
budget, then the same within that bucket alone. What shares the last boundary bucket gives its part in proportion, so
that the words taken meet the target to within a word a document of that bucket. Nothing is sorted but a source's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import running
from .common import fresh, settle, small, table

BITS, LEVELS = 12, 3
#: Largest number of times that a document, and so a source, may be taken.
REPEATS = 3


def doc_hash(id_col: str) -> Column:
    """The first 36 bits of the md5 of the id as text; null counts as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def source_targets(rows: DataFrame, weights: list[int]) -> DataFrame:
    """source, source_size, target of each source; rows: source, size.

    Sources by code point, null last, have `weights`, repeating. With caps of REPEATS * size the shares settle like water
    in vessels: by rising capacity per weight, a source is capped while the level of those after it would exceed its own.
    Places and sums come from sorted ranges, so that sources may be as many as hosts.
    """
    sums = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    nth = running(sums, [], [F.col("source").asc_nulls_last()])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighed = settle(nth.withColumn("w", w).select("source", "source_size", "w"))
    words, every = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    words, every = words or 0, every or 0
    rise = [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    cap = F.col("source_size") * REPEATS
    ranked = running(weighed, [], rise, "nth", {"capped": cap, "weight": F.col("w")})
    # Before its place: words given to sources at their caps, and the weight that is left from it on.
    ranked = settle(ranked.withColumns({"left_words": F.lit(words) - F.col("capped") + cap, "left_w": F.lit(every) - F.col("weight") + F.col("w")}))
    free = ranked.where(cap * F.col("left_w") >= F.col("left_words") * F.col("w"))
    first = free.agg(F.min(F.struct("nth", "left_words", "left_w")).alias("first")).first()["first"]
    at, level, over = (first["nth"], first["left_words"], first["left_w"]) if first else (every + 1, 0, 1)
    target = F.when(F.col("nth") >= at, (F.lit(level) * F.col("w")).cast("double") / F.lit(over)).otherwise(cap.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, edge (boundary bucket at full depth, null: all pass), part (share of that bucket's words) for budgets (source, rest)."""
    found = budgets.select("source", F.col("rest"), F.lit(0).cast("long").alias("edge"), F.lit(False).alias("over"))
    total = BITS * LEVELS
    for level in range(1, LEVELS + 1):
        here = F.shiftright("h", total - BITS * level)
        prior = small(found.where(~F.col("over")).select(F.col("source").alias("s"), F.col("edge").alias("e"), F.col("rest").alias("r")))
        inside = rows.join(prior, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", total - BITS * (level - 1)) == F.col("e")))
        sums = inside.groupBy("s", here.alias("bucket")).agg(F.sum("size").alias("words"), F.first("r").alias("r"))
        run = W.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        edge = sums.groupBy("s").agg(F.first("r").alias("r"), F.max("upto").alias("all"), F.min(F.when(F.col("upto") > F.col("r"), F.struct("bucket", "upto", "words"))).alias("b"))
        found = settle(edge.select(
            F.col("s").alias("source"), (F.col("r") - (F.col("b.upto") - F.col("b.words"))).alias("rest"), F.col("b.bucket").alias("edge"),
            F.col("b").isNull().alias("over"), F.col("b.words").alias("words"),
        ))
    return found.select("source", "edge", (F.col("rest").cast("double") / F.col("words")).alias("part"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: s, source_size, target, whole, edge, part; rows: source, size, h. Small if few sources are."""
    goal = settle(source_targets(rows, list(weights)))
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(REPEATS)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    edges = thresholds(rows.where("size > 0"), goal.where("rest > 0"))
    plan = goal.join(edges.withColumnRenamed("source", "es"), F.col("source").eqNullSafe(F.col("es")), "left").drop("es", "rest")
    return small(settle(plan).withColumnRenamed("source", "s"))


def _taken(size: Column, h: Column, plan: str = "") -> Column:
    """Words that the plan's columns take of a document."""
    edge = F.col(f"{plan}edge")
    more = F.when(h < edge, size).when(h == edge, F.floor(size * F.col(f"{plan}part")).cast("long")).otherwise(F.lit(0))
    return F.col(f"{plan}whole") * size + more


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken. Weights are those of the sources by code point, null last, repeating.

    taken counts words, repeats included: `floor(target / source_size)` whole copies, one more below the source's hash
    threshold, and at the threshold itself a part of the document in proportion. Documents are chosen by a hash of their
    id, so reruns agree. Defined cases: null text and empty text have size 0 and are never taken; null is a source of its
    own; repeated ids and null ids share a hash and so share the boundary's part; an empty table gives no rows; columns
    other than id, text and source are not read.
    """
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), doc_hash(id_col).alias("h")))
    out = rows.join(mix_plan(rows, weights), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(F.col("size"), F.col("h")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The rows of `docs` of which the mix takes words, with all their columns and `taken`; rules and cases as for mix_sources.

    Texts stay where they are: the plan, a row per source, goes to them. A column of docs that is called taken is
    replaced; any others may have any names.
    """
    rows = settle(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), doc_hash(id_col).alias("h")))
    plan, key = fresh(docs, "plan", "plan_source")
    told = small(settle(mix_plan(rows, weights).select(F.struct("whole", "edge", "part").alias(plan), F.col("s").alias(key))))
    out = docs.join(told, F.col(source_col).eqNullSafe(F.col(key)))
    taken = _taken(word_count(F.col(text_col)), doc_hash(id_col), f"{plan}.")
    return out.withColumn("taken", taken).where(F.col("taken") > 0).drop(plan, key)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER rise AS nth,
         (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (rise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(w) OVER (rise ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM s WINDOW rise AS (ORDER BY source_size / w ASC, source ASC NULLS LAST)),
f AS (SELECT nth, left_words, left_w FROM r WHERE 3 * source_size * left_w >= left_words * w ORDER BY nth LIMIT 1),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.nth >= f.nth THEN (f.left_words * r.w)::DOUBLE / f.left_w::DOUBLE ELSE (3 * r.source_size)::DOUBLE END AS target
  FROM r, f),
g AS (SELECT *, least(floor(target / greatest(source_size, 1)), 3)::BIGINT AS whole FROM t),
b AS (SELECT *, floor(target - whole * source_size)::BIGINT AS rest FROM g),
c AS (SELECT source, h, sum(size)::BIGINT AS words, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM d WHERE size > 0 GROUP BY source, h),
e AS (
  SELECT b.source, min(c.h) AS edge, arg_min(b.rest - (c.upto - c.words), c.h)::DOUBLE / arg_min(c.words, c.h) AS part
  FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source AND c.upto > b.rest WHERE b.rest > 0 GROUP BY b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (b.whole * d.size + CASE WHEN d.h < e.edge THEN d.size WHEN d.h = e.edge THEN floor(d.size * e.part) ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
