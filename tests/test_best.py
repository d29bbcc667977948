"""Searches at size: what they move, and that leaving out postings leaves out no result."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sqlcheck
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.operators import best, dense, fusion, sparse, strategies
from siftline.plans import retrieval_queries, shared

WORDS = ["of", "tower", "mill", "stone", "river", "guild", "loom", "cheese", "weir", "canal", "ford", "levee"]


def texts(n, seed, most):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(WORDS, weights=[1.0 / (i + 1) for i in range(len(WORDS))], k=rnd.randint(1, most))) for _ in range(n)]


def shuffled(spark, run):
    """What a run gives and the records it writes to shuffles."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def test_sparse_search_moves_no_pairs_and_equals_all_of_them(spark):
    config = EngineConfig(analyzer="whitespace")
    docs = spark.createDataFrame([(f"d{i * 7919 % 3000:05}", t) for i, t in enumerate(texts(3000, 1, 9))], "doc_id string, text string").repartition(4)
    asked = [(i, t) for i, t in enumerate(texts(150, 2, 5))] + [(900, "tower tower unknown"), (901, "unknown"), (902, "")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    built = sparse.build(docs, config)
    got, moved = shuffled(spark, lambda: [tuple(r) for r in sparse.search(q, built, 7, config).orderBy("query_id", "rank").collect()])
    terms = sparse.query_terms(q, "whitespace")
    every = sparse.scores(terms, sparse.weights(built.posted, built.idf, built.stats, config), built.idf)
    assert got == [tuple(r) for r in sparse.ranked(every, 7).orderBy("query_id", "rank").select("query_id", "point_id", "score", "rank").collect()]
    assert len(got) == 151 * 7
    assert moved < every.count() / 10


def test_passes_and_numeric_ids(spark, monkeypatch):
    config = EngineConfig(analyzer="whitespace")
    docs = spark.createDataFrame(list(enumerate(texts(300, 3, 6), -100)), "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(texts(40, 4, 3))), "query_id int, text string")
    built = sparse.build(docs, config)
    want = [tuple(r) for r in sparse.search(q, built, 5, config).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(sparse, "PASS", 7)
    without = sparse.Index(built.posted, built.idf, built.stats)
    assert [tuple(r) for r in sparse.search(q, without, 5, config).orderBy("query_id", "rank").collect()] == want
    every = sparse.ranked(sparse.scores(sparse.query_terms(q, "whitespace"), sparse.weights(built.posted, built.idf, built.stats, config), built.idf), 5)
    assert want == [tuple(r) for r in every.orderBy("query_id", "rank").select("query_id", "point_id", "score", "rank").collect()]
    assert sparse.search(q.where(F.lit(False)), built, 5, config).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_blocks_and_bounds_leave_out_no_result(monkeypatch, seed):
    monkeypatch.setattr(best, "FIRST", 16)
    monkeypatch.setattr(best, "LARGEST", 64)
    rnd = random.Random(seed)
    docs = [Counter(t.split()) for t in texts(700, seed, 12)]
    names = [f"{rnd.choice('abc')}{i:04}" for i in rnd.sample(range(9999), len(docs))]
    lengths = [sum(d.values()) for d in docs]
    asked = [Counter(t.split()) for t in texts(60, seed + 100, 6)]
    # a term of negative weight, one of none, and one that no document holds
    idf = {w: [-0.2, 0.0, 0.1, 0.4, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0][i] for i, w in enumerate(WORDS)} | {"unknown": 0.0}
    terms = sorted(idf)
    average, k = sum(lengths) / len(lengths), rnd.choice([1, 5, 40])
    starts = np.cumsum([0, *[len(a) for a in asked]])
    payload = best.Asked(terms, np.array([idf[t] for t in terms]), starts, np.array([terms.index(t) for a in asked for t in a]), np.array([float(n) for a in asked for n in a.values()]), average, 1.5, 0.75, k)
    table = pa.table({"doc_id": names, "len": pa.array(lengths, pa.int32()), "terms": [list(d) for d in docs], "tfs": [list(d.values()) for d in docs]})
    got = {}
    for b in best.search(iter(table.to_batches(max_chunksize=90)), payload):
        for q, i, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
            got.setdefault(q, []).append((-s, i))
    for q, a in enumerate(asked):
        want = []
        for i, d, n in zip(names, docs, lengths, strict=True):
            if any(t in d and idf[t] for t in a):
                s = sum(a[t] * idf[t] * (d[t] * 2.5) / (d[t] + 1.5 * (0.25 + 0.75 * n / average)) for t in a if t in d)
                want.append((-round(s, 9), i))
        assert [(round(s, 8), i) for s, i in sorted(got.get(q, []))] == [(round(s, 8), i) for s, i in sorted(want)[:k]]


def test_dense_search_gives_a_task_k_rows_of_each_query(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 20)
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((400, 4)), rng.standard_normal((30, 4))
    points = spark.createDataFrame([(f"p{i:03}", v.tolist()) for i, v in enumerate(x)], "point_id string, dense array<double>").coalesce(1)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "query_id int, dense array<double>").coalesce(1)
    assert dense.scores(q, points, 3, "Dot", 4).count() == 30 * 3
    got = [(r.query_id, r.point_id) for r in dense.topk(q, points, 3, "Dot", 4).orderBy("query_id", "rank").collect()]
    assert got == [(i, f"p{j:03}") for i in range(30) for j in np.argsort(-(x @ y[i]))[:3]]
    monkeypatch.setattr(dense, "HELD", 100)  # given on in between
    assert [(r.query_id, r.point_id) for r in dense.topk(q, points, 3, "Dot", 4).orderBy("query_id", "rank").collect()] == got


def test_deduplication_by_hash_moves_no_texts(spark):
    rows = [(1, "p1", "T", "Same  Body", "a", 1), (1, "p2", " t", "same body ", "b", 2), (1, "p3", "T", " ", "other", 3), (1, "p4", "T", None, "OTHER", 4), (1, "p5", None, "same body", "a", 5)]
    full = spark.createDataFrame(rows, "query_id int, point_id string, title string, context_text string, text string, rank int")
    slim = full.select("query_id", "point_id", "rank", fusion.body_hash())
    plain = lambda df: [tuple(r) for r in df.select("point_id", "rank", "dedupe_rank", "duplicate_aliases").orderBy("dedupe_rank").collect()]
    assert plain(fusion.dedupe(slim, "rank", 2)) == plain(fusion.dedupe(full, "rank", 2)) == [("p1", 1, 1, ["p2"]), ("p3", 3, 2, ["p4"])]
    assert fusion.dedupe(slim, "rank", 2).columns == ["query_id", "point_id", "rank", "dedupe_rank", "duplicate_aliases"]
    assert fusion.dedupe_metrics(slim).first() == fusion.dedupe_metrics(full).first()


@pytest.mark.parametrize("name", ["sparse_mode_topk", "hybrid_topk", "dedupe_metrics"])
def test_no_texts_are_shuffled_for_deduplication(spark, sf, name):
    plan = retrieval_queries.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "xxhash64" in plan and "FlatMapGroups" not in plan
    for line in plan.splitlines():
        if "Window" in line or "Aggregate" in line:
            assert "context_text" not in line and "xxhash64" not in line


def test_proxy_writes_no_pairs(spark, raw):
    made = texts(300, 6, 8)
    rows = strategies.study_rows(raw(*[{"question": q, "candidates": [a, b], "long_answers": [a]} for q, a, b in zip(made[:100], made[100:200], made[200:], strict=True)])).localCheckpoint()
    chunks = strategies.build(rows, "raw_candidate").localCheckpoint()
    queries = strategies.study_queries(rows, 1).localCheckpoint()
    hits, moved = shuffled(spark, lambda: strategies.proxy_hits(queries, chunks, rows, 3).collect())
    assert len(hits) == 100 * 3 and len({(h.query_id, h["rank"]) for h in hits}) == 300
    words = {q.query_id: set(q.text.split()) for q in queries.collect()}
    pairs = sum(bool(words[q] & set(c.text.split())) for q in words for c in chunks.select("text").collect())
    assert pairs > 10_000 and moved < pairs / 2


def test_reranking_ships_no_fields_to_the_join_with_queries(spark, sf, monkeypatch):
    seen = []
    real = retrieval_queries._with_fields
    monkeypatch.setattr(retrieval_queries, "_with_fields", lambda hits, *a: seen.append(hits.columns) or real(hits, *a))
    assert retrieval_queries.rerank_lexical(spark, sf).columns == ["query_id", "point_id", "fusion_rank", "rerank_rank", "rerank_score"]
    assert seen == [["query_id", "point_id", "fusion_rank", "query"]]


def test_marks_pass_all_wanted_rows_and_few_others(spark, monkeypatch):
    rows = [(f"k{i}" if i % 50 else None, i) for i in range(20_000)]
    table = spark.createDataFrame(rows, "id string, n int")
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(0, 20_000, 7)] * 2 + [(None,), ("unknown",)], "id string")
    assert shared.among(table, "id", wanted) is table  # few rows: the join moves nothing
    monkeypatch.setattr(shared, "SMALL_ROWS", 100)
    got = shared.among(table, "id", wanted)
    assert got.columns == ["id", "n"]
    passed = [r.n for r in got.collect()]
    hit = {i for i in range(0, 20_000, 7) if i % 50}
    assert len(passed) == len(set(passed)) and hit <= set(passed) and len(passed) < len(hit) + 20_000 / 10
    assert shared.among(table, "id", wanted.limit(0)) is table
    monkeypatch.setattr(shared, "MARKED_ROWS", 1_000)
    assert shared.among(table, "id", wanted) is table


@pytest.mark.parametrize("name", ["rerank_inputs", "prompts", "citation_filter", "prompt_budget", "grounded_heuristic"])
def test_texts_that_no_query_hits_stay(spark, sf, monkeypatch, name):
    d = sf.replace("sf0.001", "sf0.01")
    monkeypatch.setattr(shared, "SMALL_ROWS", 0)
    monkeypatch.setattr(retrieval_queries, "small", lambda df: df.hint("merge"))  # as beyond the size that is sent to every executor
    real, moved = retrieval_queries._with_fields, []

    def counted(hits, *a):
        hits = shared.cut(hits)
        moved.append(shuffled(spark, lambda: real(hits, *a).write.format("noop").mode("overwrite").save())[1])
        return real(hits, *a)

    monkeypatch.setattr(retrieval_queries, "_with_fields", counted)
    sqlcheck.same(spark, d, retrieval_queries.QUERIES[name], retrieval_queries.ORACLES[name], sqlcheck.connect(d))
    assert len(moved) == 1 and moved[0] < spark.read.parquet(f"{d}/index_chunks.parquet").count()


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Forty questions that all hit the same ten texts of 80 kB."""
    rnd, d = random.Random(5), str(tmp_path_factory.mktemp("long"))
    long = [" ".join(["needle", *(f"{rnd.getrandbits(32):08x}" for _ in range(9_000)), "needle."]) for _ in range(10)]
    said = [*long, *texts(390, 8, 9)]
    rows = [(f"c{i:03}", f"g{i}", t, t if i % 3 else None, i, 0, 1, ["paragraph", None], "T" if i % 2 else None, "s", "where is the needle?", None, None, "paragraph", 1, 1, ["x"]) for i, t in enumerate(said)]
    rows += [(f"d{i:03}", f"h{i}", " tower. ", " ", 20 * i, 2, 2, None, None, "s", "where is the needle?", None, None, "paragraph", 1, 1, None) for i in range(40)]
    schema = "chunk_id string, group_id string, text string, context_text string, source_row_ordinal bigint, start_candidate_idx int, end_candidate_idx int, passage_types array<string>, title string, source string, question string, document_url string, parent_candidate_idx int, chunk_kind string, token_count int, context_token_count int, long_answers array<string>"
    spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{d}/index_chunks.parquet")
    return d, sum(map(len, long))


@pytest.mark.parametrize("name", ["prompts", "grounded_heuristic", "prompt_budget"])
def test_long_texts_move_no_more_than_the_budget(spark, long_texts, monkeypatch, name):
    d, size = long_texts
    monkeypatch.setattr(shared, "SMALL_ROWS", 0)
    monkeypatch.setattr(retrieval_queries, "small", lambda df: df.hint("merge"))

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    retrieval_queries._index(spark, d)  # moves the terms of all texts
    before = written()
    sqlcheck.same(spark, d, retrieval_queries.QUERIES[name], retrieval_queries.ORACLES[name], sqlcheck.connect(d))
    assert written() - before < size / 4


def test_citations_and_evidence_come_from_one_search(spark, sf, monkeypatch):
    real, asked = retrieval_queries._sparse, []
    monkeypatch.setattr(retrieval_queries, "_sparse", lambda s, d, k: asked.append(k) or real(s, d, k))
    sqlcheck.same(spark, sf, retrieval_queries.citation_filter, retrieval_queries.ORACLES["citation_filter"], sqlcheck.connect(sf))
    assert asked == [retrieval_queries.K]
