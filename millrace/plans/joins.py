"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import runs
from ..operators.lastwins import left_join_last
from .catalog import query, table


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def train_minus_test(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) ORDER BY first_id LIMIT 100")
def common_tasks(spark, sf_dir):
    return runs.common_ids(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").limit(100)


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_first(spark, sf_dir):
    return runs.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_last(spark, sf_dir):
    return runs.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.pending(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS value, NULL::VARCHAR AS name FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customer', c_custkey, NULL, c_name FROM customer")
def union_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return orders.unionByName(customers, allowMissingColumns=True)


@query("SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def dim_enrich(spark, sf_dir):
    people, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = people.join(nations, people.c_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_bal"))


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, coalesce(l.toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT a.bs::INTEGER AS bs, b.sbs::INTEGER AS sbs, c.th, (a.bs % b.sbs = 0) AS valid FROM (VALUES (8), (16), (32)) a(bs), (VALUES (4), (8), (12)) b(sbs), (VALUES (0.2::DOUBLE), (0.8::DOUBLE)) c(th)")
def grid_expand(spark, sf_dir):
    return runs.grid(spark, {"bs": [8, 16, 32], "sbs": [4, 8, 12], "th": [0.2, 0.8]}).select(F.col("bs").cast("int"), F.col("sbs").cast("int"), "th", (F.col("bs") % F.col("sbs") == 0).alias("valid"))


SHORT_BLOCK = 1_000


def items_inside(docs, items):
    """(item_id, docs): how many documents hold an item's whole text.

    Pairs are tried by a word inside the item, which both must have, so no cross join is needed. Items under four words have
    none; they are searched in all documents, at most about SHORT_BLOCK of them at a time.
    """
    items = items.where("text <> ''").select("item_id", F.col("text").alias("item")).distinct()
    docs = docs.select("doc_id", "text")
    inner = F.filter(F.split("item", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    word = F.when(F.size(inner) > 3, F.try_element_at(inner, F.lit(3)))  # neither the first nor the last word: those may go on outside
    items = items.withColumn("word", word)
    heads = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("word"))
    likely = heads.join(items.select("item_id", "word"), "word").select("doc_id", "item_id").distinct()
    named = docs.withColumnRenamed("doc_id", "d"), items.where("word IS NOT NULL").withColumnRenamed("item_id", "i")
    held = likely.join(named[0], F.col("doc_id").eqNullSafe(F.col("d"))).join(named[1], F.col("item_id").eqNullSafe(F.col("i"))).where(F.contains("text", "item"))
    held = held.select("item_id", "doc_id")

    short = items.where("word IS NULL").select("item_id", "item")
    blocks = -(-short.count() // SHORT_BLOCK)
    for b in range(blocks):
        side = short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b)
        held = held.unionByName(docs.join(F.broadcast(side), F.contains("text", "item")).select("item_id", "doc_id"))
    return held.distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT item_id, count(*) AS docs FROM (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '') GROUP BY 1")
def contamination(spark, sf_dir):
    """Whole benchmark texts inside documents."""
    return items_inside(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT a.user_id, a.v AS clicks, b.v AS buys, round(a.v - b.v, 6) AS delta FROM (SELECT user_id, round(avg(value), 6) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) a JOIN (SELECT user_id, round(avg(value), 6) AS v FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1) b USING (user_id)")
def paired_modes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    side = lambda end, name: events.join(F.broadcast(ends), F.col("event_type") == F.col(end)).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias(name))
    return side("lo", "clicks").join(side("hi", "buys"), "user_id").withColumn("delta", F.round(F.col("clicks") - F.col("buys"), 6))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) INTERSECT SELECT s_nationkey FROM supplier")
def id_sets(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    known = table(spark, sf_dir, "nation").select("n_nationkey").join(rich, "n_nationkey", "left_semi")
    return known.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")))


@query("SELECT o_orderkey, o_totalprice, (lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) IS NULL AS fresh FROM orders")
def change_marks(spark, sf_dir):
    run = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lag("o_totalprice").over(run).isNull().alias("fresh"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_suppkey END AS custkey FROM lineitem),
o AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS last_price, max_by(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey)
SELECT l.*, last_price, last_status FROM l LEFT JOIN o ON o_custkey = custkey""")
def last_wins_join(spark, sf_dir):
    """A quarter of all lines have one key, whose orders' last counts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, 1).otherwise(F.col("l_suppkey")).alias("custkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_totalprice").alias("last_price"), F.col("o_orderstatus").alias("last_status"))
    return left_join_last(lines, orders, "custkey", F.col("o_orderkey"), ["last_price", "last_status"], hot=5_000)
