"""Table functions over diffs, for SQL and lateral joins: a row per file, and lines that changed."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: A header line, as diffs.HEADER has it; lines end with \n alone.
_HEADER = re.compile(r"^diff --git a/[^\n]* b/[^\n]*$", re.M)


def _chunks(diff: str) -> list[str]:
    """From each header to the next; what stands before the first is left out."""
    starts = [m.start() for m in _HEADER.finditer(diff)]
    return [diff[a:b] for a, b in zip(starts, [*starts, len(diff)][1:], strict=True)]


def _file(chunk: str) -> str:
    """What follows the header's first " b/"."""
    return chunk.split("\n", 1)[0].partition(" b/")[2].strip()


@F.udtf(returnType="pos int, file string, chunk string")
class SplitDiff:
    """split_diff(diff): a row per file, as `diffs.split_diff` has them; none for null or a text without headers."""

    def eval(self, diff: str | None) -> Iterator[tuple[int, str, str]]:
        pos = 0
        for chunk in _chunks(diff or ""):
            yield pos, _file(chunk), chunk
            pos += 1


@F.udtf
class ChangedLines:
    """changed_lines(diff, with_text => false): counts of added and deleted lines per file; with true a row per line, with its sign and text. The columns follow the argument."""

    @staticmethod
    def analyze(diff: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(diff.dataType, (T.StringType, T.NullType)):
            raise ValueError("diff must be a string")
        if with_text is not None and (not with_text.isConstantExpression or not isinstance(with_text.value, bool)):
            raise ValueError("with_text must be a constant")
        wide = with_text is not None and with_text.value
        return AnalyzeResult(schema=_schema("file string, sign string, line string" if wide else "file string, added bigint, deleted bigint"))

    def eval(self, diff: str | None, with_text: bool = False) -> Iterator[tuple]:
        for chunk in _chunks(diff or ""):
            file, lines = _file(chunk), chunk.split("\n")
            changed = [x for x in lines if (x[:1] == "+" and x[:3] != "+++") or (x[:1] == "-" and x[:3] != "---")]
            if with_text:
                for x in changed:
                    yield file, x[0], x[1:]
            else:
                yield file, sum(x[0] == "+" for x in changed), sum(x[0] == "-" for x in changed)


def _schema(columns: str) -> T.StructType:
    """A struct of "name kind" pairs, as the functions' own process has no session to parse them."""
    kinds = {"string": T.StringType(), "bigint": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    spark.udtf.register("split_diff", SplitDiff)
    spark.udtf.register("changed_lines", ChangedLines)
