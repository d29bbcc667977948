from __future__ import annotations

import json

import pytest

from siftline.operators import audit, ingest
from siftline.sources import jsonl, sinks


def test_lines_have_dense_ordinals(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": f"r{i}", "candidates": ["x" * 50]}) + "\n\n" for i in range(200)))
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": "last", "candidates": None}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = jsonl.raw_rows(spark, f"file://{tmp_path}").orderBy("row_ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_ordinal for r in got] == list(range(201))
    assert [r.id for r in got] == [f"r{i}" for i in range(200)] + ["last"]


def test_lines_that_are_no_objects_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("[1]\n")
    with pytest.raises(Exception):  # noqa: B017
        jsonl.raw_rows(spark, f"file://{tmp_path}/a.jsonl").collect()


def test_mixed_index_records(spark, tmp_path):
    lines = [
        {"chunk_id": "c1", "group_id": "g", "text": "flat", "context_text": "flat"},
        {"passage_id": "p1", "text": "passage"},
        {"group_id": "g2", "source_row_ordinal": 1, "texts": [{"text_idx": 0, "text": "a"}, {"text_idx": 1, "text": "b"}], "chunks": [{"chunk_id": "c2", "text_idxs": [0, 1], "context_idxs": [1]}]},
    ]
    (tmp_path / "i.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r.record_kind, r.point_id, r.text, r.context_text) for r in ingest.index_records(jsonl.index_lines(spark, f"file://{tmp_path}/i.jsonl")).collect()}
    assert got == {("chunk", "c1", "flat", "flat"), ("passage", "p1", "passage", None), ("group", "c2", "a b", "b")}


def test_tables_are_skipped_while_fresh(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(3)
    first = sinks.write_table(df, path, {"a": 1})
    assert first["rows"] == 3 and sinks.is_fresh(spark, path, {"a": 1}) and not sinks.is_fresh(spark, path, {"a": 2})
    assert sinks.write_table(spark.range(9), path, {"a": 1})["rows"] == 3
    assert sinks.write_table(spark.range(9), path, {"a": 2})["rows"] == 9
    spark.range(1).write.mode("append").parquet(path)
    assert not sinks.is_fresh(spark, path, {"a": 2})
    (tmp_path / "bad.json").write_text("{")
    assert sinks.read_json(spark, f"file://{tmp_path}/bad.json") is None and sinks.read_json(spark, f"file://{tmp_path}/none.json") is None


def test_copy_is_verified(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.createDataFrame([("p", [1.0])], "point_id string, dense array<double>").write.parquet(a)
    assert sinks.copy_points(spark, a, b, dry_run=True)["copied"] == 0
    assert sinks.copy_points(spark, a, b)["copied"] == 1
    with pytest.raises(RuntimeError):
        sinks.copy_points(spark, a, b)
    assert sinks.copy_points(spark, a, b, recreate=True)["copied"] == 1
    with pytest.raises(RuntimeError):
        sinks.assert_sparse_ready(spark.range(1))


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("sparse", 1, 2, 0.5, 0.5, 0.4)], "mode string, k int, query_count bigint, recall_at_k double, mrr_at_k double, ndcg_at_k double")
    report = sinks.write_report(spark, m, f"file://{tmp_path}/r")
    assert sinks.read_json(spark, f"file://{tmp_path}/r.json") == report
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r.csv").count() == 1
    assert "| sparse | 1 |" in sinks.markdown(m, "M")


def test_audit(spark, raw):
    df = raw({"candidates": ["It has parts:", "wheel", "", "end of all things that go on for more than sixteen words in one single line of text here"]}, {"candidates": ["wheel"]})
    assert [(r.left_idx, r.right_idx, r.likely) for r in audit.continuity_pairs(df).orderBy("left_idx").collect()] == [(0, 1, True), (1, 3, False)]
    s = audit.continuity_summary(df).first()
    assert (s.scanned_rows, s.total_candidates, s.adjacent_pairs, s.likely_continuations, s.likely_ratio) == (2, 4, 2, 1, 0.5)
    assert [(r.text, r.occurrences, r.distinct_rows) for r in audit.duplicate_text_groups(df).collect()] == [("wheel", 2, 2)]
    flat = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", None), (4096, "b", None), (4097, "a", None), (9000, "a", "q")], "line bigint, title string, question string").selectExpr("*", "cast(null as string) document_url")
    assert [(r.group_no, r.first_row, r.last_row, r.members) for r in audit.contiguous_groups(flat, "line").orderBy("group_no").collect()] == [(0, 0, 1, 2), (1, 2, 4096, 2), (2, 4097, 4097, 1), (3, 9000, 9000, 1)]
