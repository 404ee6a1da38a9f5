"""Choosing tasks: scores, diversity, quotas, nearest matches, batches and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs, selection, stats
from .catalog import query, table


def _tasks(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("length"), F.max("l_partkey").alias("part"))
    return items.withColumn("repo", F.col("part") % 7).withColumn("score", F.col("length") % 101)


_TASKS = "(SELECT l_orderkey, count(*) AS n_files, sum(l_quantity::BIGINT)::BIGINT AS length, max(l_partkey) % 7 AS repo, sum(l_quantity::BIGINT)::BIGINT % 101 AS score FROM lineitem GROUP BY 1)"


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY n_files, repo ORDER BY score DESC, l_orderkey) AS rr FROM {_TASKS}),
b AS (SELECT *, row_number() OVER (PARTITION BY n_files ORDER BY (rr = 1) DESC, score DESC, l_orderkey) AS k FROM a)
SELECT n_files, l_orderkey, k FROM b WHERE k <= 5""")
def diversity_topk(spark, sf_dir):
    return selection.diverse_top(_tasks(spark, sf_dir), "n_files", "repo", "score", "l_orderkey", 5).select("n_files", "l_orderkey", "k")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY n_files, repo ORDER BY score DESC, l_orderkey) = 1 AS f FROM {_TASKS}),
b AS (SELECT *, coalesce(sum(f::INT) OVER (PARTITION BY n_files ORDER BY score DESC, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY n_files ORDER BY score DESC, l_orderkey) AS k FROM b WHERE f OR c >= 5)
SELECT n_files, l_orderkey, k FROM d WHERE k <= 10""")
def quota_select(spark, sf_dir):
    return selection.quota_pick(_tasks(spark, sf_dir), "n_files", "repo", "score", "l_orderkey", F.lit(10)).select("n_files", "l_orderkey", "k")


@query(f"""WITH c AS (SELECT n_files, count(*) AS n FROM {_TASKS} GROUP BY 1), q AS (SELECT n_files, n, least(CASE WHEN n_files >= 4 THEN floor(greatest(5, floor(500 * n / sum(n) OVER ())) * 1.5) ELSE greatest(5, floor(500 * n / sum(n) OVER ())) END, n)::BIGINT AS q FROM c)
SELECT n_files, n, CASE WHEN sum(q) OVER () > 500 THEN greatest(1, floor(q * (500.0::DOUBLE / sum(q) OVER ()))) ELSE q END::BIGINT AS quota FROM q""")
def quotas(spark, sf_dir):
    return selection.quotas(_tasks(spark, sf_dir), "n_files", 500)


@query("""SELECT l_orderkey, round(CASE WHEN n < 2 OR a < 15 OR a > 40 THEN -1.0 ELSE log2(least(n, 10)) * 1.5 + exp(-pow((a - 25) / 12, 2)) * 2 + 1 / (1 + s / a) + 0.5 END, 6) AS score
FROM (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS a, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1)""")
def suitability_score(spark, sf_dir):
    """The score's form, with bounds and ideal on the scale of quantities."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("a"), F.max("l_quantity").alias("m"), stats.spread(F.col("l_quantity")).alias("cv"))
    score = selection.suitability(F.col("n"), F.col("a"), F.col("m"), F.col("cv"), F.lit(False), low=15, high=40, top=1e9, ideal=25, width=12)
    return each.select("l_orderkey", F.round(score, 6).alias("score"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, (o_orderkey % 7)::INT AS w, (o_orderkey % 9000)::INT AS len FROM orders)
SELECT o_orderkey, round(-0.5 * 2.0 - abs(len - 5500) / 3000.0 + CASE WHEN w >= 4 THEN 0.5 WHEN w >= 3 THEN 0.3 ELSE 0 END + 3 * 0.1, 6)::DOUBLE AS profiling,
round(CASE WHEN w >= 5 THEN 2.0 WHEN w >= 4 THEN 1.5 WHEN w >= 3 THEN 1.0 WHEN w <= 1 THEN -2.0 ELSE 0 END + CASE WHEN len BETWEEN 3000 AND 7000 THEN 0.5 ELSE 0 END + least(3, 5) * 0.2 - CASE WHEN w < 2 THEN 1.0 ELSE 0 END, 6)::DOUBLE AS evaluation FROM o""")
def task_scores(spark, sf_dir):
    words, length = (F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % 9000).cast("int")
    chars = F.when(words < 2, 5).otherwise(30)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(selection.profiling_score(F.lit(0.5), length, words, F.lit(3)), 6).alias("profiling"), F.round(selection.evaluation_score(words, length, F.lit(3), chars), 6).alias("evaluation")
    )


@query("""SELECT lang, batch, count(*) AS n, max(n_chars) AS longest, (max(n_chars) * count(*) - sum(n_chars))::BIGINT AS padding FROM (SELECT lang, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 8 AS batch FROM documents) GROUP BY 1, 2""")
def batch_plan(spark, sf_dir):
    return runs.batches(table(spark, sf_dir, "documents"), "lang", "n_chars", "doc_id", 8)


@query("""WITH c(cap) AS (VALUES (500), (1000), (2000), (4000)), t AS (SELECT doc_id, cap, n_chars, CASE WHEN n_chars > cap THEN greatest(floor((n_chars // 4) * cap / greatest(n_chars, 1)), 1) ELSE n_chars // 4 END::BIGINT + 40 AS tok FROM documents, c),
b AS (SELECT cap, n_chars, tok, (row_number() OVER (PARTITION BY cap ORDER BY tok, doc_id) - 1) // 8 AS batch FROM t),
p AS (SELECT cap, batch, max(tok) * count(*) - sum(tok) AS pad, sum(greatest(n_chars - cap, 0)) AS cut, count(*) FILTER (WHERE n_chars > cap) AS n_cut FROM b GROUP BY 1, 2)
SELECT cap::INTEGER AS cap, sum(pad)::BIGINT AS padding, sum(cut)::BIGINT AS cut_chars, sum(n_cut)::BIGINT AS cut_files, round(sum(pad) / 1000.0 + 2 * sum(cut) / 10000.0, 6) AS composite FROM p GROUP BY cap""")
def cap_grid(spark, sf_dir):
    return selection.cap_grid(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("n_chars") / 4).alias("tokens")), "doc_id", "n_chars", "tokens", [500, 1000, 2000, 4000], 8, 40)


@query(f"""WITH t(target) AS (VALUES (2), (4), (6)), c AS (SELECT target, l_orderkey, n_files, row_number() OVER (PARTITION BY target ORDER BY abs(n_files - target), n_files DESC, l_orderkey) AS k FROM t JOIN {_TASKS} ON n_files = target)
SELECT target::INTEGER AS target, l_orderkey, k FROM c WHERE k <= 3""")
def nearest_strata(spark, sf_dir):
    return selection.nearest(_tasks(spark, sf_dir), "n_files", "l_orderkey", [2, 4, 6], 3)
