"""Result files wherever they are, by a Python data source: a file of lines, summaries at any depth, or a folder of documents.

The source only finds files and hands out their texts; each lot of documents and each span of a large file of lines is a partition of its own. Parsing is
Spark's. A folder of documents gets the summary that it lacks, so that the next read opens one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..settled import file_system
from .readers import RESULTS

#: The name of a summary. A fixed value.
SUMMARY = "_results_summary.jsonl"
#: Documents of a partition; bytes of a span of lines; bytes that are read at once.
LOT, SPAN, BLOCK = 500, 64 << 20, 1 << 20


@dataclass
class Documents(InputPartition):
    """Files that hold one document each."""

    files: list[str]


@dataclass
class Lines(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _listed(fs: pa.fs.FileSystem, path: str, deep: bool) -> list[pa.fs.FileInfo]:
    return sorted((f for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=deep)) if f.type == pa.fs.FileType.File), key=lambda f: f.path)


def layout(path: str) -> tuple[str, list[tuple[str, int]]]:
    """("lines" or "documents" or "missing", [(file, bytes)]): the file itself; else the folder's summary; else all summaries below it; else its own documents.

    Documents end in .json, those with errors too; names that begin with _ are none.
    """
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return "lines", [(at, info.size)]
    if info.type != pa.fs.FileType.Directory:
        return "missing", []
    own = fs.get_file_info(f"{at.rstrip('/')}/{SUMMARY}")
    if own.type == pa.fs.FileType.File:
        return "lines", [(own.path, own.size)]
    if found := [f for f in _listed(fs, at, True) if f.base_name == SUMMARY]:
        return "lines", [(f.path, f.size) for f in found]
    return "documents", [(f.path, f.size) for f in _listed(fs, at, False) if f.base_name.endswith(".json") and not f.base_name.startswith("_")]


class ResultFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        kind, files = layout(self.path)
        if kind == "documents":
            return [Documents([f for f, _ in files[i : i + LOT]]) for i in range(0, len(files), LOT)]
        return [Lines(f, at, min(at + SPAN, size)) for f, size in files for at in range(0, size, SPAN)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was found
            return
        fs, _ = _opened(self.path)
        if isinstance(partition, Documents):
            for file in partition.files:
                with fs.open_input_stream(file) as f:
                    yield self._batch(file, [f.read()])
            return
        yield from self._spanned(fs, partition)

    def _spanned(self, fs: pa.fs.FileSystem, span: Lines) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(span.file) as f:
            at, rest = span.start, b""
            if at:  # the line that goes over the start is the span's before
                f.seek(at - 1)
                at -= 1
                while (block := f.read(BLOCK)) and b"\n" not in block:
                    at += len(block)
                if not block:
                    return
                at += block.index(b"\n") + 1
                f.seek(at)
            while at < span.end or rest:
                block = f.read(BLOCK)
                *lines, rest = (rest + block).split(b"\n")
                if not block:
                    lines, rest = [rest], b""
                told = []
                for line in lines:
                    if at >= span.end:
                        break
                    told.append(line)
                    at += len(line) + 1
                if told:
                    yield self._batch(span.file, told)
                if not block or at >= span.end:
                    return

    @staticmethod
    def _batch(file: str, texts: list[bytes]) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in texts if t.strip()]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(texts, pa.string())], ["file", "value"])


class ResultFiles(DataSource):
    """spark.read.format("result_files").load(path): (file, value), a row per line or document."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> ResultFilesReader:
        return ResultFilesReader(self.options)


def texts(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ResultFiles)
    return spark.read.format("result_files").load(path)


def materialise(spark: SparkSession, folder: str) -> str | None:
    """Writes the summary of a folder of documents, in the order of their names; unreadable ones are left out. Its path, or None without documents.

    One task writes the lines beside the documents under a name of its own, and the file is then renamed: readers see no summary or a whole one. Whoever is
    second finds the first one's and drops its own.
    """
    docs = texts(spark, folder).select("file", F.to_json(F.try_parse_json("value")).alias("value")).where("value IS NOT NULL")
    if docs.isEmpty():
        return None
    part, target = f"{folder.rstrip('/')}/_part-{uuid.uuid4().hex}", f"{folder.rstrip('/')}/{SUMMARY}"
    fs, at = file_system(spark, part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        docs.orderBy("file").select("value").coalesce(1).write.text(part)
        written = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")]
        if not fs.exists(path(target)):
            fs.rename(written[0], path(target))
    finally:
        fs.delete(at, True)
    return target


def load_results(spark: SparkSession, path: str, schema: str = RESULTS, write_summary: bool = True) -> DataFrame:
    """Records of `schema` and `file`, from whatever is at the path; a missing path has no rows.

    Bad lines of a summary fail the read, as they would be losses; unreadable documents are skipped; blank lines are none. Documents of failures are rows
    without label. A folder of documents is written down as a summary first, where that is wanted.
    """
    kind, files = layout(path)
    if kind == "documents" and files and write_summary:
        materialise(spark, path)
        kind = layout(path)[0]
    found = texts(spark, path)
    if kind == "documents":
        found = found.where(F.try_parse_json("value").isNotNull())
    return found.select("file", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*", "file")
