import pytest

from millrace.plans import QUERIES, SQL, joins
from tests.oracle import check


@pytest.mark.parametrize("block", [1_000, 2])
def test_items_of_few_words_equal_the_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(joins, "SHORT_BLOCK", block)
    docs = [(1, "a b cats and more"), (2, "the cat, sat?! on it"), (3, "!!"), (4, None), (5, "one two three four five"), (5, "one two three four fives"), (None, "cat a b cats"), (None, "cat")]
    items = [(1, "a b cat"), (2, "cat"), (3, "!"), (4, "at, sa"), (5, ""), (6, None), (7, "two three four fi"), (8, "ne two three f"), (9, "absent"), (None, "cat"), (2, "one"), (10, "on it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import tests.oracle as oracle

    monkeypatch.setattr(oracle, "TABLES", ["documents", "benchmark"])
    check(spark, QUERIES["contamination"], SQL["contamination"], str(tmp_path))
