import json

from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import append

SCHEMA = "task_id string, pipeline_mode string, error string, v bigint"


def lines(path, *records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_jsonl_modes(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"task_id": "a", "v": 1}, "", "{bad", {"task_id": "b", "v": 2})
    assert {r.task_id for r in readers.jsonl(spark, p, SCHEMA, "drop").collect()} >= {"a", "b"}
    kept = readers.jsonl(spark, p, SCHEMA, "keep").cache()
    assert kept.where("_bad IS NOT NULL").count() == 1
    try:
        readers.jsonl(spark, p, SCHEMA).collect()
        raise AssertionError("a bad line passed")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()


def test_folders_and_summaries(spark, tmp_path):
    d = tmp_path / "bs8_sbs4_th0.8_cacheTrue_batch2_mnt64"
    d.mkdir()
    (d / "a.json").write_text('{"task_id": "a",\n "v": 1}')
    (d / "b.error.json").write_text('{"task_id": "b", "error": "x"}')
    (d / "_c.json").write_text('{"task_id": "c"}')
    found = readers.json_folder(spark, str(tmp_path), SCHEMA, recursive=True)
    got = readers.with_run_parameters(found, F.col("file")).collect()
    assert [(r.task_id, r.block_size, r.threshold, r.cache, r.max_new_tokens) for r in got] == [("a", 8, 0.8, True, 64)]
    assert [r.task_id for r in readers.results(spark, str(d), SCHEMA).collect()] == ["a"]
    lines(d / "_results_summary.jsonl", {"task_id": "s", "v": 3})
    assert [r.task_id for r in readers.results(spark, str(d), SCHEMA).collect()] == ["s"]
    assert readers.results(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_union_prefers_final(spark, tmp_path):
    final = readers.jsonl(spark, lines(tmp_path / "f.jsonl", {"task_id": "a", "v": 1}), SCHEMA)
    ckpt = readers.jsonl(spark, lines(tmp_path / "c.jsonl", {"task_id": "a", "v": 2}, {"task_id": "b", "v": 3}), SCHEMA)
    assert sorted(r.v for r in readers.final_and_checkpoint(final, ckpt, "task_id").collect()) == [1, 3]
    assert sorted(r.task_id for r in readers.id_list(spark, lines(tmp_path / "ids.txt", "a", "", " b ")).collect()) == ["a", "b"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("x", "b", 1.0, "d|e"), ("AR", "a", 2.0, None)], "model_type string, config string, score double, label string")
    writers.csv(df, str(tmp_path / "csv"), ["config", "score", "nothing"], first="model_type = 'AR'")
    text = next((tmp_path / "csv").glob("part-*")).read_text().split()
    assert text == ["config,score", "a,2.0", "b,1.0"]
    assert "| d\\|e |" in writers.markdown(df, "T") and "–" in writers.markdown(df)
    assert json.loads(writers.document(df.orderBy("config")))[0]["score"] == 2.0
    writers.by_run(df, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("config = 'a'").count() == 1
    writers.ids(df.withColumnRenamed("config", "task_id"), str(tmp_path / "ids"), "score")
    assert next((tmp_path / "ids").glob("part-*")).read_text().split() == ["a", "b"]


def test_stream_takes_each_key_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines(src / "1.jsonl", {"task_id": "a", "pipeline_mode": "m", "v": 1}, {"task_id": "b", "pipeline_mode": "m", "error": "no"})
    run = lambda: append.finished_once(append.appended(spark, str(src), SCHEMA), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    lines(src / "2.jsonl", {"task_id": "a", "pipeline_mode": "m", "v": 2}, {"task_id": "c", "pipeline_mode": "m", "v": 3})
    run()
    assert sorted((r.task_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("c", 3)]


def test_dates_and_speed(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z", (None, 2.0)), ("bad", (1.0, 2.0))], "d string, stats struct<batch_tokens_per_second:double,tokens_per_second:double>")
    got = df.select(F.date_format(readers.parse_date(F.col("d")), "yyyy-MM"), readers.speed()).collect()
    assert [tuple(r) for r in got] == [("2024-01", 2.0), (None, 1.0)]
