"""Readers of records: JSON lines, JSON documents, folders of them, id lists. Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import runs

#: The fields of records.
MESSAGES = "array<struct<role:string,content:string>>"
COMMITS = "owner string, repo string, commit_sha string, diff string, message string, files array<string>, author string, date string, loc bigint"
TASKS = f"task_id string, messages {MESSAGES}, label string, files array<string>, diff_length bigint, context_length bigint"
RESULTS = (
    "task_id string, pipeline_mode string, label string, generated string, n_files bigint, file_summaries array<struct<filename:string,summary:string>>, "
    "timing struct<summary_wall_s:double,cmg_wall_s:double,total_wall_s:double,task_wall_s:double>, token_counts struct<summary_tokens_per_file:array<bigint>,cmg_tokens:bigint>, "
    "stats struct<prompt_tokens:bigint,generated_tokens:bigint,batch_wall_seconds:double,batch_size:bigint,batch_total_tokens:bigint,batch_total_steps:bigint,batch_tokens_per_second:double,"
    "tokens_per_second:double,effective_ms_per_token:double,ms_per_token:double,tokens_per_step:double,wall_seconds:double,prefill_seconds:double>, error string, traceback string"
)
#: A run's parameters in the name of its folder. A fixed value.
RUN_NAME = r"bs(\d+)_sbs(\d+)_th([0-9.]+)_cache(True|False)_batch(\d+)_mnt(\d+)"


def jsonl(spark: SparkSession, path: str | list[str], schema: str, on_error: str = "fail") -> DataFrame:
    """JSON lines. Bad lines fail the read, are dropped ("drop"), or come back in `_bad` ("keep"); blank lines are none."""
    if on_error == "keep":
        return spark.read.schema(T.StructType.fromDDL(f"{schema}, _bad string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[on_error]).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_folder(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """A JSON document a file, with `file`. Names that begin with _ or end in .error.json are left out, unreadable files too."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive).option("mode", "DROPMALFORMED")
    found = reader.option("ignoreCorruptFiles", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    return found.where(~F.endswith("file", F.lit(".error.json")))


def _exists(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(is there, is a folder), asked of the path's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p), fs.exists(p) and fs.getFileStatus(p).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)[0]


def _under_a_plain_name(spark: SparkSession, path: str) -> str | None:
    """A copy of a file whose name Spark's readers hide, in the session's shared folder, until the session ends; None if the file isn't there.

    The copy is streamed from file system to file system, whatever its size.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    there = source.getFileSystem(conf)
    if not there.exists(source):
        return None
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/summary-{uuid.uuid4().hex}.jsonl")
    here = target.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(there, source, here, target, False, conf)
    here.deleteOnExit(target)
    return target.toString()


def results(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Results wherever they are: a file of lines, a folder with a summary file, or a folder of documents. A missing path has no rows."""
    there, folder = _exists(spark, path)
    if not there:
        return spark.createDataFrame([], schema)
    if not folder:
        return jsonl(spark, path, schema, "drop")
    summary = _under_a_plain_name(spark, f"{path}/_results_summary.jsonl")
    if summary is not None:
        return jsonl(spark, summary, schema, "drop").where("task_id IS NOT NULL")
    return json_folder(spark, path, schema, recursive=True).drop("file")


def with_run_parameters(df: DataFrame, path: Column) -> DataFrame:
    """df with the parameters that the run's folder name tells; rows of other folders are left out."""
    part = lambda i, kind: F.regexp_extract(path, RUN_NAME, i).cast(kind)
    return df.where(F.regexp_like(path, F.lit(RUN_NAME))).select(
        "*", part(1, "int").alias("block_size"), part(2, "int").alias("small_block_size"), part(3, "double").alias("threshold"),
        (F.regexp_extract(path, RUN_NAME, 4) == "True").alias("cache"), part(5, "int").alias("batch_size"), part(6, "int").alias("max_new_tokens"),
    )


def keyed(df: DataFrame, key: str, order: str) -> DataFrame:
    """A row per key, the last by order."""
    return runs.keep_last(df, [key], order)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("task_id")).where("task_id <> ''").distinct()


def final_and_checkpoint(final: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Both, the final record winning."""
    return runs.first_of_sources(final, checkpoint, key=key)


def speed(stats: str = "stats") -> Column:
    """Tokens a second by either schema of results, 0 where neither has it."""
    return F.coalesce(F.col(f"{stats}.batch_tokens_per_second"), F.col(f"{stats}.tokens_per_second"), F.lit(0.0))


def parse_date(c: Column) -> Column:
    """The first 19 characters as a time; null for anything else."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
