"""All layouts of results, summaries that are written back, and roots that disagree on fields."""

import json
import os

import pytest

from millrace.sources import result_files, roots

SCHEMA = "task_id string, label string, error string, v bigint"


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n", encoding="utf-8")
    return str(path)


def got(df):
    return sorted((r.task_id, r.label, r.v) for r in df.collect())


def test_a_file_and_a_missing_path(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", {"task_id": "a", "label": "é", "v": 1}, "", "   ", {"task_id": "b", "v": 2, "more": [1]})
    assert got(result_files.load_results(spark, p, SCHEMA)) == [("a", "é", 1), ("b", None, 2)]
    assert result_files.load_results(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert result_files.load_results(spark, put(tmp_path / "empty.jsonl", ""), SCHEMA).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        result_files.load_results(spark, put(tmp_path / "bad.jsonl", "{bad"), SCHEMA).collect()


def test_own_summary_and_summaries_below(spark, tmp_path):
    put(tmp_path / "x" / "run1" / result_files.SUMMARY, {"task_id": "a", "v": 1})
    put(tmp_path / "x" / "deep" / "er" / "run2" / result_files.SUMMARY, {"task_id": "b", "v": 2}, {"task_id": "c", "v": 3})
    put(tmp_path / "x" / "stray.json", {"task_id": "no"})
    assert got(result_files.load_results(spark, str(tmp_path / "x"), SCHEMA)) == [("a", None, 1), ("b", None, 2), ("c", None, 3)]
    put(tmp_path / "x" / result_files.SUMMARY, {"task_id": "own", "v": 9})
    assert got(result_files.load_results(spark, str(tmp_path / "x"), SCHEMA)) == [("own", None, 9)]


def test_documents_get_a_summary(spark, tmp_path):
    d = tmp_path / "run"
    for i in range(7):
        put(d / f"{i}.json", json.dumps({"task_id": f"t{i}", "v": i, "label": "two\nlines"}, indent=2))
    put(d / "x.error.json", {"task_id": "failed", "error": "boom"})
    put(d / "y.json", "{unreadable")
    put(d / "_z.json", {"task_id": "hidden"})
    put(d / "sub" / "q.json", {"task_id": "below"})
    want = sorted([(f"t{i}", "two\nlines", i) for i in range(7)] + [("failed", None, None)], key=repr)
    first = result_files.load_results(spark, str(d), SCHEMA, write_summary=False)
    assert sorted(((r.task_id, r.label, r.v) for r in first.collect()), key=repr) == want and len({r.file for r in first.collect()}) == 8
    assert not (d / result_files.SUMMARY).exists()
    result_files.load_results(spark, str(d), SCHEMA).collect()
    again = result_files.load_results(spark, str(d), SCHEMA).collect()
    assert sorted(((r.task_id, r.label, r.v) for r in again), key=repr) == want
    assert {os.path.basename(r.file) for r in again} == {result_files.SUMMARY}  # one file is opened
    assert [json.loads(x)["task_id"] for x in (d / result_files.SUMMARY).read_text().splitlines()] == [f"t{i}" for i in range(7)] + ["failed"]
    assert not [p for p in os.listdir(d) if p.startswith("_part")]
    (tmp_path / "nothing").mkdir()
    assert result_files.load_results(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0
    (d / result_files.SUMMARY).write_text('{"task_id": "first"}\n')
    result_files.materialise(spark, str(d))  # there is one: it stays
    assert got(result_files.load_results(spark, str(d), SCHEMA)) == [("first", None, None)]


def test_lines_of_spans_are_read_once(tmp_path, monkeypatch):
    lines = ["x" * (i % 37) + str(i) for i in range(500)] + ["", "é" * 50, "last without end"]
    p = tmp_path / "f.jsonl"
    p.write_bytes("\n".join(lines).encode())
    for span in (1, 7, 64, 1000, 1 << 20):
        for block in (3, 50, 1 << 20):
            monkeypatch.setattr(result_files, "SPAN", span)
            monkeypatch.setattr(result_files, "BLOCK", block)
            if span == 1 and block > 3:
                continue
            reader = result_files.ResultFilesReader({"path": str(p)})
            found = [v for part in reader.partitions() for b in reader.read(part) for v in b.column("value").to_pylist()]
            assert found == [x for x in lines if x.strip()], (span, block)


def test_roots_that_disagree(spark, tmp_path):
    run = "bs8_sbs4_th0.8_cacheTrue_batch2_mnt64"
    put(tmp_path / "a" / run / "1.json", {"task_id": "1", "label": "l", "generated": "g", "stats": {"batch_tokens_per_second": 2.5, "tokens_per_second": 1}})
    put(tmp_path / "a" / run / "1.error.json", {"task_id": "1e", "error": {"message": "m"}})
    put(tmp_path / "a" / "notes" / "1.json", {"task_id": "no run"})
    put(tmp_path / "b" / run.replace("64", "32") / "2.json", {"id": 2, "label": {"text": "inner"}, "stats": None, "timing": {"total_wall_s": 3}})
    put(tmp_path / "base" / "3.json", {"task_id": "3", "label": ["a"], "reference": "ref", "stats": {"tokens_per_second": "7.5"}, "error": "e"})
    put(tmp_path / "base" / "4.json", "[broken")
    put(tmp_path / "two" / "cfg" / "5.json", {"task_id": "5", "token_counts": {"cmg_tokens": 12}})
    where = roots.standard_roots(str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "base"), str(tmp_path / "two"), str(tmp_path / "absent"))
    rows = {r.task_id: r for r in roots.load_roots(spark, where).collect()}
    assert set(rows) == {"1", "1e", "2", "3", "5"}
    assert (rows["1"].config, rows["1"].model_type, rows["1"].block_size, rows["1"].cache, rows["1"].label, rows["1"].tps) == (run, "dLLM", 8, True, "l", 2.5)
    assert (rows["1e"].error, rows["1e"].label) == ("m", None)
    assert (rows["2"].label, rows["2"].tps, rows["2"].wall_s, rows["2"].max_new_tokens) == ("inner", None, 3.0, 32)
    assert (rows["3"].config, rows["3"].model_type, rows["3"].label, rows["3"].tps, rows["3"].batch_size, rows["3"].cache) == ("AR_baseline", "AR", "ref", 7.5, 1, None)
    assert (rows["5"].config, rows["5"].model_type, rows["5"].generated_tokens, rows["5"].max_new_tokens) == ("twostep_dllm_cfg", "dLLM_TwoStep", 12, 128)
