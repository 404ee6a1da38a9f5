import tests.oracle as oracle
from millrace.plans import QUERIES, SQL


def test_texts_are_padded_whole_or_rejected(spark, tmp_path, monkeypatch):
    sizes = {1: 5, 2: 512, 3: 513, 4: 600, 5: 2048, 6: 2049, 7: 0}
    rows = [(i, "w " * n) for i, n in sizes.items()] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.ids, r.learnt) for r in QUERIES["padded_examples"](spark, str(tmp_path)).collect()}
    assert got == {i: (-(-n // 32) * 32, n) for i, n in sizes.items() if n <= 2048}
    monkeypatch.setattr(oracle, "TABLES", ["documents"])
    oracle.check(spark, QUERIES["padded_examples"], SQL["padded_examples"], str(tmp_path))
