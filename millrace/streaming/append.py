"""Incremental results: a folder of appended JSON lines, read as a stream, each key taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import readers


def appended(spark: SparkSession, path: str, schema: str = readers.RESULTS) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def finished_once(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("task_id", "pipeline_mode")) -> StreamingQuery:
    """Writes records without error that the target doesn't have yet, all that is there now, then ends. Started again, it goes on from there.

    A batch that is repeated after a failure finds its own rows in the target and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = batch.where(F.col("error").isNull() | (F.col("error") == ""))
        # Of several records of a key the smallest by its JSON stays, so that a batch that is repeated gives the same rows.
        fresh = done.groupBy(*keys).agg(F.min_by(F.struct(*done.columns), F.to_json(F.struct(*done.columns))).alias("r")).select("r.*")
        if readers.exists(spark, target):
            known = spark.read.schema(batch.schema).parquet(target).select(*keys)  # the keys' columns alone are read
            fresh = fresh.join(known, list(keys), "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, time: str, kind: str, late: str = "2 days") -> DataFrame:
    """Counts by day and kind with a bound for late rows; an extension, as the rules have no windows over time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")
