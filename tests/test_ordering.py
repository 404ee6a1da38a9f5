import random

from pyspark.sql import functions as F

from millrace.operators.ordering import running


def test_places_and_sums_without_one_large_task(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = running(df, ["g"], [F.col("v").desc(), F.col("i")], sums={"upto": F.col("v")}).collect()
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [(r.v, r.i, r.place) for r in mine] == [(v, i, k) for k, (_, v, i) in enumerate(want, 1)]
        assert [r.upto for r in mine] == [sum(x[1] for x in want[: k + 1]) for k in range(len(want))]
    every = running(df, [], [F.col("i")]).collect()
    assert all(r.place == r.i + 1 for r in every) and running(df.limit(0), ["g"], [F.col("i")]).count() == 0
