"""The draw follows its weights, and toxicity is in windows, not in labels or order of rows."""

import math

from pyspark.sql import functions as F

from millrace.llm import quality, toxicity


def test_inclusion_rates_follow_the_weights(spark):
    """Of 6,000 rows with weights 4, 2 and 1 in thirds, 600 draws: successive sampling takes them in proportion but for what runs out."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, math.log(4.0)).when(F.col("id") % 3 == 1, math.log(2.0)).otherwise(0.0).alias("w"))
    got = {r["g"]: r["k"] for r in quality.gumbel_top(rows, "w", 600, "id").where("kept").groupBy((F.col("id") % 3).alias("g")).agg(F.count("*").alias("k")).collect()}
    assert sum(got.values()) == 600
    want = {0: 600 * 4 / 7, 1: 600 * 2 / 7, 2: 600 / 7}
    assert all(abs(got[g] - want[g]) < 0.2 * want[g] + 15 for g in want), got
    none = quality.gumbel_top(rows.withColumn("w", F.lit(None).cast("double")), "w", 5, "id")
    assert none.where("kept").count() == 0 and quality.gumbel_top(rows, "w", 0, "id").where("kept").count() == 0


def test_logistic_finds_the_chances():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=4000), np.ones(4000)], axis=1)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = quality.logistic(x, y)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 1) < 0.2


def test_gains_are_of_windows():
    model = toxicity.Model(" the cat sat on a mat and slept all day long ".encode("utf-16-le") * 20, " grobnix  flumox ".encode("utf-16-le"), 0.1)
    gains = toxicity.Gains(model)
    clean, foul = gains.of("the cat sat on a mat"), gains.of("the cat sat on a grobnix mat")
    assert clean[1:].sum() == 0 and foul[1:].sum() >= 1
    # A passage that repeats is one window; distinct windows with the word count each.
    assert gains.of("the cat sat grobnix " * 50).sum() <= 4
    assert gains.of(None).sum() == gains.of(" ").sum() == 0 and gains.of("grobnix").sum() == 1
    assert toxicity.windows("a b c d e") == [w.encode("utf-16-le") for w in (" a b c d ", " c d e ")]
