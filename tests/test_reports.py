"""Reports of small results, the end of a run, and statistics that SQL can't say."""

import json
import os
import re

import pytest

from millrace.operators import runstats
from millrace.sources import writers


@pytest.fixture
def small(spark):
    return spark.createDataFrame([("a</script><b>", 1, 0.5), ("é ", 22, None)], "name string, n long, x double").coalesce(1)


def test_pages_and_tables(small):
    page = writers.html_page(small, "T & <x>")
    held = re.search(r"const DATA = (.*);</script>", page)[1]
    assert page.count("</script>") == 1 and json.loads(held) == [{"name": "a</script><b>", "n": 1, "x": 0.5}, {"name": "é ", "n": 22, "x": None}] and "T &amp; &lt;x&gt;" in page
    assert writers.fixed_width(small).split("\n")[:2] == ["name            n       x", "a</script><b>   1  0.5000"]
    assert writers.report([("One", small), ("Two", small)], "All").count("## ") == 2
    with pytest.raises(ValueError):
        writers.fixed_width(small.sparkSession.range(writers.REPORT_ROWS + 1))


def test_finishing_drops_the_checkpoint(spark, small, tmp_path):
    checkpoint = tmp_path / "ckpt"
    writers.jsonl(small, str(checkpoint))
    writers.finish(spark.read.json(str(checkpoint)), str(tmp_path / "final"), str(checkpoint))
    assert not os.path.exists(checkpoint) and spark.read.json(str(tmp_path / "final")).count() == 2
    writers.finish(small, str(tmp_path / "final"), str(checkpoint))


def test_subsets_and_metrics(spark):
    whole, part = spark.range(10), spark.range(3)
    runstats.require_subset(part, whole, "id")
    with pytest.raises(ValueError, match="7 values"):
        runstats.require_subset(whole, part, "id")
    with pytest.raises(ValueError, match="no metric 'nope'"):
        runstats.metric(whole, "nope", ("id",))


def test_speeds_without_tokens_or_time_are_finite(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*runstats.generation_stats(F.lit(0), F.lit(0), F.lit(0.0), F.lit(1.0)), *runstats.two_step_stats(F.lit(0), F.lit(0.0), F.lit(5), F.lit(0), F.lit(0.0))).first()
    assert all(v is not None and abs(v) < float("inf") for v in row) and row.decode_seconds == 0.0 and row.tokens_per_second == 0.0


def test_bootstrap_means_spread_as_theory_says(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("d"))
    got = runstats.bootstrap_means(rows, "id", "d", 300).agg(F.avg("mean"), F.stddev("mean"), F.count("*")).first()
    assert got[2] == 300 and abs(got[0] - 2) < 0.03 and abs(got[1] - (2**0.5) / 20) < 0.015
