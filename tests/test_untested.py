"""Functions that no query shows: extensions, caps from percentiles, prompts, tags, cuts, single lines of diffs."""

from pyspark.sql import functions as F

from millrace.functions import diffs, text
from millrace.operators import building
from millrace.plans import config


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_extensions(spark):
    paths = ["src/Main.JAVA", "a.b/c", "README", ".gitignore", "dir/.env", "x.tar.gz", ""]
    assert one(spark, diffs.lower_extension, *paths) == ["java", "b/c", "", "gitignore", "env", "gz", ""]
    assert one(spark, diffs.plain_extension, *paths) == ["JAVA", "b/c", "no_extension", "no_extension", "env", "gz", "no_extension"]
    assert one(spark, diffs.suffix, *paths) == [".java", "", "", "", "", ".gz", ""]


def test_cuts(spark):
    assert one(spark, lambda c: diffs.cut_at_line(c, 6), "ab\ncd\nef", "abcdefgh", "short", None) == ["ab\ncd" + diffs.CUT, "abcdef" + diffs.CUT, "short", None]
    assert one(spark, lambda c: diffs.cut_tokens(F.split(c, " "), 2), "a b c", "a") == ["a b", "a"]
    assert one(spark, diffs.between_marks, f"x{diffs.START}\n q \n{diffs.END}y", f"{diffs.END}{diffs.START}", "none") == ["q", None, None]


def test_lengths_of_files(spark):
    diff = "diff --git a/x b/x\n+1\ndiff --git a/y b/y\ndiff --git a/x b/x\n+longer\n"
    (got,) = one(spark, diffs.length_by_file, diff)
    assert got == {"x": len("diff --git a/x b/x\n+longer\n"), "y": len("diff --git a/y b/y\n")}


def test_languages(spark):
    df = spark.createDataFrame([(["a.py", "b.PY", "c.md", "d.zz", "e", "f.java"],), ([],)], "f array<string>")
    got = df.select(diffs.languages(F.col("f")).alias("l"), diffs.excluded_suffixes(F.col("f")).alias("e"), diffs.code_files(F.col("f")).alias("c")).collect()
    assert got[0].l == [".zz", "Java", "Python", "unknown"] and got[0].e == [".md"] and got[0].c == ["a.py", "b.PY", "d.zz", "e", "f.java"]
    assert (got[1].l, got[1].e, got[1].c) == ([], [], [])


def test_prompts(spark):
    got = one(spark, lambda c: building.summary_prompt(c, F.lit("+a\n+b\n+c"), cap=6), "f.py")[0]
    assert got.startswith("File: f.py\n\n--- START OF FILE DIFF ---\n+a\n+b" + diffs.CUT) and "+c" not in got
    assert "+a\n+b\n+c\n--- END" in one(spark, lambda c: building.summary_prompt(c, F.lit("+a\n+b\n+c")), "f.py")[0]
    assert one(spark, text.strip_simple_tags, "<msg>x</msg> y", "<MSG>") == ["x y", "<MSG>"]


def test_caps_follow_a_percentile(spark):
    rows = [("t", 1000, 300, 250), ("t", 3000, 800, 750), ("t", 9000, 2300, 2250), ("u", 10, 60, 5)]
    files = spark.createDataFrame(rows, "task_id string, diff_chars long, prompt_tokens long, diff_tokens long")
    got = {r.task_id: r.cap for r in config.adaptive_caps(files, 50).collect()}
    # t: a target of 800 tokens; a prompt adds max(300 - 1000, 0) = 0; the most room is 800 * 1000 / 250, 800 * 3000 / 750 or 800 * 9000 / 2250.
    assert got == {"t": 3200, "u": 200}
    assert [config.diff_cap(s) for s in (None, "400", "tok:12", "adaptive", "adaptive:90")] == [("none", None), ("chars", 400), ("tokens", 12), ("adaptive", 75.0), ("adaptive", 90.0)]
