"""Every stage on an empty table, null and empty texts, a very long text, and columns with clashing names."""

import pytest

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, row_key int, plan string, plan_source string, id int, kept string, w int, h int, `a b` int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def table(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "p", "q", 2, "k", 3, 4, 5) for i, t, s in rows], COLUMNS)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage(spark, sf_dir, name, stage):
    assert stage(spark, table(spark), sf_dir).count() == 0
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = table(spark, (1, None, "a"), (2, "", None), (3, long, "a"), (4, "Some words here.", "b"), (5, "one two three four five six seven eight nine ten", "b"))
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns + (["taken"] if name == "mix" else [])
    kept = {r.doc_id for r in out.collect()}
    want = {"quality": {3, 4, 5}, "exact_dedup": {2, 3, 4, 5}, "near_dedup": {1, 2, 3, 4, 5}, "decontaminate": {1, 2, 3, 4}}
    assert kept == want[name] if name in want else kept <= {3, 4, 5} and 3 in kept
