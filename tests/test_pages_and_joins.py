"""Pages by rank, last-wins joins under hot keys, table functions, and two sinks of one scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import diffs, table_functions
from millrace.operators import lastwins, pages, percentiles
from millrace.sources import writers


def test_pages_are_slices_of_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FEW", 5)
    monkeypatch.setattr(percentiles, "BINS", 4)
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.0, 1.0, 2.5, rng.random()]), rng.randint(0, 3), "x" * rng.randint(0, 4)) for i in rng.sample(range(1000), 137)]
    df = spark.createDataFrame(rows, "id long, ts double, gt int, label string").repartition(4).cache()
    key = {
        "default": lambda r: r[0], "ts_desc": lambda r: -(r[1] or 0), "ts_asc": lambda r: r[1] or 0, "gt_desc": lambda r: -(r[2] or 0), "gt_asc": lambda r: r[2] or 0,
        "label_short": lambda r: len(r[3]), "label_long": lambda r: -len(r[3]),
    }
    orders = pages.sample_orders("ts", "gt", "label")
    assert set(orders) == set(key)
    asked = [(name, 2, 3) for name in orders] + [("gt_desc", 0, 3), ("gt_desc", 6, 3), ("gt_desc", 7, 3), ("label_short", 2, 10_000)]
    for name, page, ties in asked:
        monkeypatch.setattr(pages, "TIES", ties)
        want = [r[0] for r in sorted(rows, key=lambda r: (key[name](r), r[0]))]
        got = sorted((r._place, r.id) for r in pages.page_at(df, orders[name], "id", page, 20).collect())
        assert got == [(20 * page + i, x) for i, x in enumerate(want[20 * page : 20 * page + 20])], (name, page)
    low = pages.nulls_lowest("ts", False)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    seen, last = [], None
    while part := pages.page_after(df, low, "id", last, 50).collect():
        seen += [r.id for r in part]
        last = (part[-1]._number, part[-1].id)
    assert seen == want
    assert pages.page_at(df.limit(0), low, "id", 0, 10).count() == 0


def test_last_wins_with_a_hot_key(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i % 11) for i in range(300)] + [(900, None)], "i int, k int").repartition(6)
    right = spark.createDataFrame([(7, 1, "old"), (7, 3, "new"), (7, 2, None), (0, 5, "zero"), (99, 1, "unmet"), (None, 1, "null"), (4, None, "none")], "k int, at int, v string")
    for hot in (10, 1_000_000):
        got = {r.i: r.v for r in lastwins.left_join_last(left, right, "k", F.col("at"), ["v"], hot=hot).collect()}
        assert len(got) == 301 and got[900] is None
        assert all(got[i] == ("new" if i % 3 or i % 11 == 7 else {0: "zero", 4: "none"}.get(i % 11)) for i in range(300))
    assert lastwins.left_join_last(left, right.limit(0), "k", F.col("at"), ["v"]).where("v IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="both sides"):
        lastwins.left_join_last(left, right.withColumn("i", F.lit(1)), "k", F.col("at"), ["i"])


DIFFS = [
    None, "", "no header\n+x", "before\ndiff --git a/x.py b/x.py\n--- a\n+++ b\n+one\n-two\n+\n", "diff --git a/a b/c b/d\n+q\ndiff --git a/e b/e\n-r\n++s\n--- t\n",
    " diff --git a/x b/x\n+no", "diff --git a/é.md b/é.md",
]


def test_table_functions_give_what_columns_give(spark):
    table_functions.register(spark)
    df = spark.createDataFrame(list(enumerate(DIFFS)), "i int, diff string")
    df.createOrReplaceTempView("some_diffs")
    want = df.select("i", F.posexplode(diffs.split_diff(F.col("diff"))).alias("pos", "f")).select("i", "pos", "f.file", "f.chunk").collect()
    assert sorted(want) == sorted(spark.sql("SELECT i, f.* FROM some_diffs, LATERAL split_diff(diff) f").collect())
    files = df.select("i", F.explode(diffs.split_diff(F.col("diff"))).alias("f")).select("i", "f.file", diffs.added_lines(F.col("f.chunk")).alias("added"), diffs.deleted_lines(F.col("f.chunk")).alias("deleted"))
    assert sorted(files.collect()) == sorted(spark.sql("SELECT i, f.* FROM some_diffs, LATERAL changed_lines(diff) f").collect())
    lines = spark.sql("SELECT i, f.* FROM some_diffs, LATERAL changed_lines(diff, true) f")
    assert lines.columns == ["i", "file", "sign", "line"] and lines.where("i = 3").count() == 3
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT f.* FROM some_diffs, LATERAL changed_lines(diff, i > 1) f").collect()


def test_two_sinks_of_one_scan(spark, tmp_path):
    rows = [("a", "lä\nb", 1), ("b", None, None), ("c", "中😀\"\\", 3)]
    tasks = spark.createDataFrame(rows, "task_id string, label string, n int").repartition(2)
    scans = spark.sparkContext.accumulator(0)
    for _ in range(2):  # the second overwrites
        writers.tasks_and_labels(tasks.select("*", F.udf(lambda: scans.add(1) or 1, "int")().alias("seen")), str(tmp_path / "t"), str(tmp_path / "deep" / "l"))
    read = lambda p: sorted((json.loads(x) for f in p.glob("part-*") for x in f.read_text("ascii").splitlines()), key=lambda r: r["task_id"])
    assert read(tmp_path / "t") == [{"task_id": a, "label": b, "n": c, "seen": 1} for a, b, c in rows]
    assert read(tmp_path / "deep" / "l") == [{"task_id": a, "label": b} for a, b, _ in rows]
    assert scans.value == 2 * len(rows)  # each row was made once a call
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deep", "t"]
    writers.tasks_and_labels(tasks.limit(0), str(tmp_path / "t"), str(tmp_path / "deep" / "l"))
    assert read(tmp_path / "t") == []
