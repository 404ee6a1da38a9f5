"""Writers: JSON lines, CSV with chosen columns, id lists, documents of small results, appended checkpoints."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settled import file_system

#: Rows that a report or a document on the driver may have.
REPORT_ROWS = 10_000


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines in UTF-8; mode append adds to a checkpoint."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def tasks_and_labels(tasks: DataFrame, tasks_path: str, labels_path: str) -> None:
    """Folders of JSON lines of whole tasks and of (task_id, label), in ASCII, from one scan of the tasks.

    Each row gives a line for either sink; one job writes both beside the first folder, and finished folders are then moved to their places, so
    that readers see all of a sink or nothing.
    """
    spark, options = tasks.sparkSession, {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "false"}
    line = lambda *columns: F.to_json(F.struct(*columns), options)
    whole = line(*[F.col(f"`{c}`") for c in tasks.columns])
    both = F.array(F.struct(F.lit("tasks").alias("sink"), whole.alias("value")), F.struct(F.lit("labels").alias("sink"), line("task_id", "label").alias("value")))
    scratch = f"{tasks_path.rstrip('/')}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, scratch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        tasks.select(F.inline(both)).write.partitionBy("sink").text(scratch)
        for sink, target in (("tasks", tasks_path), ("labels", labels_path)):
            made = path(f"{scratch}/sink={sink}")
            fs.mkdirs(made)  # no rows, no folder
            fs.delete(path(target), True)
            fs.mkdirs(path(target).getParent())
            if not fs.rename(made, path(target)):
                raise OSError(f"can't move {sink} to {target}")
    finally:
        fs.delete(at, True)


def csv(df: DataFrame, path: str, columns: Iterable[str], first: str | None = None, order: str = "config") -> None:
    """The given columns under a header, rows with a true `first` before others; one file, as reports are small."""
    ranks = ([F.when(F.expr(first), 0).otherwise(1)] if first else []) + [F.col(order)]
    df.orderBy(*ranks).select(*[c for c in columns if c in df.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def by_run(df: DataFrame, path: str) -> None:
    """Parquet in folders by run, so that readers skip runs they don't ask for."""
    df.write.mode("overwrite").partitionBy("config").parquet(path)


def ids(df: DataFrame, path: str, score: str) -> None:
    df.orderBy(F.desc(score), "task_id").select("task_id").coalesce(1).write.mode("overwrite").text(path)


def records(df: DataFrame) -> list[dict]:
    """Rows of a small result; a larger one is refused, not cut."""
    found = df.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError("too many rows for a document")
    return [r.asDict(recursive=True) for r in found]


def document(df: DataFrame) -> str:
    return json.dumps(records(df), indent=2, ensure_ascii=False, default=str)


def markdown(df: DataFrame, title: str = "") -> str:
    """A small result as a Markdown table."""
    cell = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in records(df)]) + "\n"


def finish(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the final records and drops the checkpoint that they came from; the checkpoint stays if writing fails, and may be gone already."""
    jsonl(df, path)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def report(sections: list[tuple[str, DataFrame]], title: str) -> str:
    """Several small results as one Markdown document, each under its heading."""
    return "\n".join([f"# {title}\n", *(markdown(df, name) for name, df in sections)])


def html_page(df: DataFrame, title: str, name: str = "DATA") -> str:
    """A page with a small result as JSON in a script. Nothing in it can end the script, or is read as markup."""
    held = json.dumps(records(df), ensure_ascii=False, default=str)
    for sign in "<>&  ":
        held = held.replace(sign, f"\\u{ord(sign):04x}")
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><script>const {name} = {held};</script></body></html>\n'


def fixed_width(df: DataFrame, places: int = 4) -> str:
    """A small result as lines of text: numbers to the right, the rest to the left."""
    cell = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    rows = records(df)
    lines = [df.columns, *([cell(r[c]) for c in df.columns] for r in rows)]
    widths = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    right = [all(isinstance(r[c], (int, float)) or r[c] is None for r in rows) and bool(rows) for c in df.columns]
    return "\n".join("  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(line, widths, right, strict=True)).rstrip() for line in lines) + "\n"
