"""Records whose fields differ in place and kind from source to source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import roots
from .catalog import query, table


@query("""SELECT event_id, 'e' || event_id AS task_id, CASE k % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '!' WHEN 3 THEN 'ref ' || event_id END AS label,
CASE WHEN k % 4 < 3 THEN value END AS tps, CASE k % 4 WHEN 2 THEN 'boom' WHEN 3 THEN 'late' END AS error, k FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def variant_records(spark, sf_dir):
    """Events as documents of four shapes, by a field of their own properties, read back by one set of rules."""
    events = table(spark, sf_dir, "events").withColumn("p", F.parse_json("props"))
    k, name = F.variant_get("p", "$.k", "bigint"), F.concat(F.lit("e"), "event_id")
    shape = (
        F.when(k % 4 == 0, F.to_json(F.struct(name.alias("task_id"), F.col("event_type").alias("label"), F.struct(F.col("value").alias("tokens_per_second")).alias("stats"), F.col("p").alias("props"))))
        .when(k % 4 == 1, F.to_json(F.struct(name.alias("id"), F.struct(F.concat("event_type", F.lit("!")).alias("text")).alias("label"), F.struct(F.col("value").alias("batch_tokens_per_second"), F.lit(0).alias("tokens_per_second")).alias("stats"), F.col("p").alias("props"))))
        .when(k % 4 == 2, F.to_json(F.struct(name.alias("task_id"), F.struct(F.lit("boom").alias("message")).alias("error"), F.col("value").cast("string").alias("tokens_per_second"), F.col("p").alias("props"))))
        .otherwise(F.to_json(F.struct(name.alias("task_id"), F.array(F.lit("x")).alias("label"), F.concat(F.lit("ref "), "event_id").alias("reference"), F.lit("late").alias("error"), F.array("value").alias("stats"), F.col("p").alias("props"))))
    )
    read = events.select("event_id", F.parse_json(shape).alias("v"))
    rules = tuple(r for r in roots.RULES if r.name in ("task_id", "label", "tps", "error")) + (roots.Rule("k", "bigint", ("$.props.k",)),)
    return read.select("event_id", *roots.by_rules(F.col("v"), rules))
