from __future__ import annotations

import pytest

from siftline.config import EngineConfig
from siftline.operators import sparse
from siftline.sources import index_store, sinks

DOCS = [("a", "the old tower of stone"), ("b", "a tower and a mill"), ("c", ""), ("d", None), ("e", "mill stones turn the mill")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


def test_stored_index_answers_as_a_fresh_one(spark, docs, tmp_path):
    path, config = f"file://{tmp_path}/index", EngineConfig()
    index, written = index_store.build(docs, path, config)
    assert written == 5
    q = spark.createDataFrame([(1, "stone mill"), (2, "nothing known")], "query_id int, text string")
    hits = lambda i: [tuple(r) for r in sparse.search(q, i, 3, config).orderBy("query_id", "rank").collect()]
    assert hits(index) == hits(sparse.build(docs, config)) and len(hits(index)) == 3
    stored = {r.doc_id: r.terms for r in spark.read.parquet(f"{path}/weights").collect()}
    want = {(r.doc_id, r.term): r.weight for r in sparse.index(docs, config).collect()}
    assert set(stored) == {"a", "b", "c", "d", "e"} and {(d, t.term): t.weight for d, ts in stored.items() for t in ts or []} == want
    m = sinks.read_json(spark, f"{path}.manifest.json")
    assert (m["rows"], m["total_tokens"], m["terms"]) == (5, 9, 6)


def test_a_broken_build_goes_on(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    index_store.build(docs, path)
    half = spark.read.parquet(f"{path}/weights").where("doc_id in ('a', 'c')").collect()
    spark.createDataFrame(half, spark.read.parquet(f"{path}/weights").schema).write.mode("overwrite").parquet(f"{path}/weights")
    assert index_store.build(docs, path)[1] == 3
    assert spark.read.parquet(f"{path}/weights").count() == 5
    assert index_store.build(docs, path)[1] == 0


def test_other_settings_or_documents_are_errors(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no whole index"):
        index_store.load(spark, path, EngineConfig())
    index_store.build(docs, path)
    with pytest.raises(ValueError, match="bm25_k1"):
        index_store.build(docs, path, EngineConfig(bm25_k1=2.0))
    more = docs.union(spark.createDataFrame([("f", "wood")], docs.schema))
    with pytest.raises(ValueError, match="other documents"):
        index_store.build(more, path)
    assert index_store.build(more, path, recreate=True)[1] == 6
    spark.read.parquet(f"{path}/idf").drop("df").write.mode("overwrite").parquet(f"{path}/idf2")
    fs, old = sinks._file(spark, f"{path}/idf")
    fs.delete(old, True)
    fs.rename(sinks._file(spark, f"{path}/idf2")[1], old)
    with pytest.raises(ValueError, match="lacks columns of idf: df"):
        index_store.load(spark, path, EngineConfig())
