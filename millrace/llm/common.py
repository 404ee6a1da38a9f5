"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many bytes and rows a side of a join counts as small enough to be broadcast; both are measured before.
BROADCAST_BYTES, BROADCAST_ROWS = 4 << 20, 50_000


def _shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on a local master, as in tests, a folder is made where that is unset; on a cluster that is an error, as executors share no local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(folder)
    return folder


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the cluster's checkpoint folder: lineage ends there, lost executors cost no more than a reread, and
    the optimizer knows the true size. (checkpoint() hands on estimates, which joins multiply from round to round.)

    The table is there until `discard`, or until the session ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of settled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            fs, at = _files(df.sparkSession, path)
            fs.delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the fast built-in; both ways give the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType).cast("long"))
        return 8 * F.greatest(F.size(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame, by one aggregate."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows, total or 0


def fits(df: DataFrame) -> bool:
    """Whether df is small enough to be broadcast, in rows and in bytes."""
    rows, total = measured(df)
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it fits; unhinted, and so free to be shuffled, otherwise."""
    return F.broadcast(df) if fits(df) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
