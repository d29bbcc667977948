from __future__ import annotations

import uuid

import pytest

from siftline.config import EngineConfig, from_mapping
from siftline.functions import ids
from siftline.operators import ingest


def test_explode(spark, raw):
    df = raw({"candidates": [" a ", "", None, "b"], "passage_types": ["list"], "title": " T ", "question": " ", "long_answers": ["1", None]}, {"candidates": ["c"], "document_url": "u"})
    got = ingest.explode_passages(df).orderBy("row_ordinal", "candidate_idx").collect()
    assert [(r.text, r.candidate_idx, r.passage_type, r.title, r.question) for r in got] == [("a", 0, "list", "T", None), ("b", 3, None, "T", None), ("c", 0, None, None, None)]
    assert got[0].long_answers == ["1"] and got[2].long_answers == []
    assert got[0].passage_id == str(uuid.uuid5(uuid.UUID(ids.PASSAGE_NAMESPACE), "nq_sample\x1ftrain\x1f0\x1f0"))
    assert [r.text for r in ingest.first_passages(ingest.explode_passages(df), 2).collect()] == ["a", "b"]
    assert ingest.first_rows(df, 1).count() == 1


def test_legacy_rows(spark):
    df = spark.createDataFrame([("1", " x ", "s"), ("2", "y", " ")], "id string, text string, title string")
    assert [(r.passage_id, r.text, r.source) for r in ingest.passages_of(df).orderBy("passage_id").collect()] == [("1", "x", "s"), ("2", "y", None)]
    for bad in ([(None, "x", None)], [("1", None, None)], [("1", " ", None)]):
        with pytest.raises(Exception, match="(?i)passage"):
            ingest.passages_of(spark.createDataFrame(bad, df.schema)).collect()


def test_extra_columns_with_clashing_names(spark, raw):
    from pyspark.sql import functions as F

    df = raw({"candidates": ["a", "b"]}).withColumns({"pos": F.lit(9), "value": F.lit("z"), "anns": F.lit(1)})
    assert ingest.explode_passages(df).count() == 2


def test_payload_drops_nulls(spark):
    df = spark.createDataFrame([("p", "t", None, [])], "chunk_id string, text string, title string, long_answers array<string>")
    r = ingest.point_payload(df).first()
    assert (r.point_id, r.payload) == ("p", '{"text":"t"}')


def test_config():
    c = from_mapping({"RAG_BM25_K1": "2.0", "RAG_RERANK_ENABLED": "yes", "RAG_MAX_PASSAGES": "5"})
    assert (c.bm25_k1, c.rerank_enabled, c.max_passages, c.max_raw_rows) == (2.0, True, 5, 5)
    assert from_mapping({"RAG_MAX_PASSAGES": "5", "RAG_MAX_RAW_ROWS": "7"}).max_raw_rows == 7
    for bad in ({"soft_tokens": 0}, {"bm25_b": 1.5}, {"analyzer": "x"}, {"distance": "x"}, {"max_passages": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
