"""Frames that are written once: lineage ends, and their size is known."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that was counted is broadcast.
SMALL_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. On a local master, as in tests, it may be unset: then it is a folder of the warehouse."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), ".settled")
    return folder


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, until `discard` or the end of the session. Lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of settled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)


def small(df: DataFrame) -> DataFrame:
    """A settled frame of numbers and short keys with a broadcast hint if it has few rows; free to be shuffled otherwise."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
