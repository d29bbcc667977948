from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.engine import Engine
from siftline.operators import dense, evaluate, fusion, generate, sparse
from siftline.streaming import resume

CORPUS = [("d1", "the cat sat on the mat"), ("d2", "the dog sat"), ("d3", "birds fly high above"), ("d4", None), ("d5", "")]


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [(i, (t or "").lower().split()) for i, t in corpus]
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split() if w in t) for i, t in docs}


def test_bm25_against_plain_python(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    q = spark.createDataFrame([(1, "the cat"), (2, "unknown"), (3, "")], "query_id int, text string")
    got = {(r.query_id, r.point_id): r.score for r in sparse.topk(q, docs, 10, EngineConfig(analyzer="whitespace")).collect()}
    want = {(1, d): s for d, s in okapi(CORPUS, "the cat").items() if d in ("d1", "d2")}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_term_ids_are_in_order_of_first_sight(spark):
    docs = spark.createDataFrame([(0, "zeta alpha zeta"), (5000, "beta alpha"), (7, "gamma beta")], "o bigint, text string")
    got = {r.term: r.term_id for r in sparse.term_ids(docs, "o", "whitespace").collect()}
    assert got == {"zeta": 0, "alpha": 1, "gamma": 2, "beta": 3}
    posted = sparse.postings(sparse.tokenized(docs.withColumnRenamed("o", "doc_id"), "whitespace"))
    assert sparse.missing_terms(posted, spark.createDataFrame([("zeta",), ("alpha",)], "term string")).count() == 2


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    q = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert sparse.topk(q, docs, 3).count() == 0
    assert sparse.corpus_stats(sparse.tokenized(docs)).first().avg_doc_len == 0.0


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_dense_against_numpy(spark, distance):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4))
    x[7] = x[3]
    pts = [(f"p{i:02}", [float(v) for v in row]) for i, row in enumerate(x)] + [("null", None), ("short", [1.0]), ("nan", [float("nan")] * 4)]
    points = spark.createDataFrame(pts, "point_id string, dense array<double>").repartition(3)
    q = spark.createDataFrame([(1, [float(v) for v in x[3]]), (2, [0.5, 1.0, -1.0, 0.0])], "query_id int, dense array<double>")
    got = [(r.query_id, r.point_id) for r in dense.topk(q, points, 5, distance, 4).orderBy("query_id", "rank").collect()]
    want = []
    for i, v in ((1, x[3]), (2, np.array([0.5, 1.0, -1.0, 0.0]))):
        s = {"Cosine": x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v), "Dot": x @ v, "Euclid": -np.linalg.norm(x - v, axis=1), "Manhattan": -np.abs(x - v).sum(1)}[distance]
        want += [(i, f"p{j:02}") for j in sorted(range(50), key=lambda j: (-round(s[j], 12), j))[:5]]
    assert got == want


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, point_id string, score double, rank int")


def test_fusion_order(spark):
    d, s = hits(spark, [(1, "p1", 0.9, 1), (1, "p2", 0.8, 2)]), hits(spark, [(1, "p2", 3.0, 1), (1, "p3", 2.0, 2)])
    got = fusion.fuse(d, s).orderBy("fusion_rank").collect()
    assert [r.point_id for r in got] == ["p2", "p3", "p1"]
    assert (got[0].dense_rank, got[0].sparse_rank, got[1].dense_rank) == (2, 1, None)


def full(spark, rows):
    return spark.createDataFrame(rows, "query_id int, point_id string, title string, context_text string, text string, fusion_rank int")


def test_dedupe_keeps_where_duplicates_came_from(spark):
    h = full(spark, [(1, "p1", "T", "Same  Body", "a", 1), (1, "p2", " t", "same body ", "b", 2), (1, "p3", "T", " ", "other", 3), (1, "p4", "T", None, "OTHER", 4), (1, "p5", None, "same body", "a", 5)])
    got = fusion.dedupe(h, "fusion_rank", 2).orderBy("dedupe_rank").collect()
    assert [(r.point_id, r.dedupe_rank, r.duplicate_aliases) for r in got] == [("p1", 1, ["p2"]), ("p3", 2, ["p4"])]
    m = fusion.dedupe_metrics(h).first()
    assert (m.raw_count, m.unique_count, m.dedupe_drop_count, round(m.dedupe_drop_rate, 4)) == (5, 3, 2, 0.4)


def test_rerank(spark):
    h = full(spark, [(1, "p1", " T ", "one two three four", "x", 1), (1, "p2", None, " ", "alpha beta", 2), (1, "p3", None, None, "z", 3)])
    scored = h.withColumn("s", F.when(F.col("point_id") == "p2", 1.0).when(F.col("point_id") == "p1", 0.0))
    assert [r.point_id for r in fusion.rerank(scored, F.col("s")).orderBy("rerank_rank").collect()] == ["p2", "p1", "p3"]
    assert [r.x for r in h.select(fusion.rerank_input(F.col("text"), F.col("context_text"), F.col("title"), 3).alias("x")).collect()] == ["Title: T\none two three", "alpha beta", "z"]
    model = lambda: lambda pairs: [float(len(t)) for _, t in pairs]
    got = fusion.rerank(h.withColumn("q", F.lit("q")), fusion.model_score(model, "q", "text")).orderBy("rerank_rank").first()
    assert (got.point_id, got.rerank_score) == ("p2", 10.0)


def test_golden_metrics(spark):
    df = spark.createDataFrame([(["p0", "p1", "p2", "p3"], ["p1", "p9"]), (["a"], [])], "ranked array<string>, relevant array<string>")
    a, b = evaluate.ranking_metrics(df, 3).collect()
    assert (a.recall, a.mrr) == (0.5, 0.5) and abs(a.ndcg - 0.38685280723454163) < 1e-12
    assert (b.recall, b.mrr, b.ndcg) == (0.0, 0.0, 0.0)


CHUNK = "chunk_id string, group_id string, text string, context_text string, title string, question string, long_answers array<string>, source_row_ordinal bigint, start_candidate_idx int, end_candidate_idx int, chunk_kind string, passage_types array<string>"


def corpus(spark):
    return spark.createDataFrame(
        [
            ("c1", "g1", "Paris is the capital of France.", None, "France", " capital of France? ", ["PARIS", " "], 1, 2, 3, "paragraph", ["p"]),
            ("c2", "g1", "Something else entirely about rivers.", "rivers and Paris together", "France", "capital of France?", ["paris"], 1, 4, 5, "paragraph", ["p"]),
            ("c3", "g2", "Berlin lies on the Spree.", None, None, "where is Berlin?", ["Hamburg"], 2, 0, 0, "paragraph", []),
            ("c4", "g3", "Unasked words", None, None, None, ["words"], 3, 0, 0, "paragraph", None),
        ],
        CHUNK,
    )


def test_gold_labels(spark):
    got = {(r.query, r.kind, r.label) for r in evaluate.gold(corpus(spark)).collect()}
    q = "capital of France?"
    assert got == {(q, "point", "c1"), (q, "point", "c2"), (q, "group", "g1"), (q, "row", "1"), (q, "span", "1:2:3"), (q, "span", "1:4:5"), (q, "answer", "PARIS"), (q, "answer", "paris")}


def test_contracts(spark):
    labels = evaluate.gold(corpus(spark)).withColumn("query_id", F.lit(7))
    h = corpus(spark).where("chunk_id <> 'c4'").withColumns({"mode": F.lit("sparse"), "query_id": F.lit(7), "point_id": F.col("chunk_id"), "rank": F.when(F.col("chunk_id") == "c3", 1).when(F.col("chunk_id") == "c1", 2).otherwise(3)})
    want = {"answer_overlap": (1.0, 0.5), "point_id": (1.0, 0.5), "group_id": (1.0, 0.5), "source_row_ordinal": (1.0, 0.5), "candidate_span_overlap": (1.0, 0.5)}
    for contract, (recall, mrr) in want.items():
        r = evaluate.metrics_per_query(h, labels, contract, [3], ["sparse"]).first()
        assert (r.recall, r.mrr) == (recall, mrr), contract
    credited = evaluate.labelled_hits(h, labels, "group_id").count()
    assert credited == 2  # both hits bear the group's label, but only the first counts
    r = evaluate.metrics_per_query(h, labels, "group_id", [1, 3], ["sparse", "dense"]).orderBy("mode", "k").collect()
    assert [(x.mode, x.k, x.recall) for x in r] == [("dense", 1, 0.0), ("dense", 3, 0.0), ("sparse", 1, 0.0), ("sparse", 3, 1.0)]
    with pytest.raises(ValueError):
        evaluate.labelled_hits(h, labels, "nothing")


def test_arguments():
    assert evaluate.resolve_k([5, 1, 5]) == [1, 5] and evaluate.resolve_k() == [10]
    assert evaluate.resolve_modes(["sparse", "sparse"]) == ["sparse"]
    for bad in ([], [0]):
        with pytest.raises(ValueError):
            evaluate.resolve_k(bad)
    with pytest.raises(ValueError):
        evaluate.resolve_modes(["x"])


def test_evidence_budget(spark):
    h = spark.createDataFrame([(1, "p1", 1, "a b", None), (1, "p2", 2, " ", " "), (1, "p3", 3, "x", "c d e f"), (1, "p4", 4, "g", None)], "query_id int, point_id string, rank int, text string, context_text string")
    got = [(r.point_id, r.evidence_no, r.body) for r in generate.evidence(h, 3).orderBy("rank").collect()]
    assert got == [("p1", 1, "a b"), ("p3", 2, "c")]
    r = generate.heuristic(generate.evidence(h, 3)).first()
    assert (r.answer, r.point_id, r.abstained) == ("a b", "p1", False)


def test_replies(spark):
    replies = [
        '{"answer": " yes ", "citations": ["p1", {"point_id": "p2"}, "zz", "p1"], "supported_claims": [{"claim": " c ", "point_ids": ["p1", "zz"]}, {"claim": "d", "point_ids": ["zz"]}], "unsupported_claims": [{"claim": "e", "reason": " r "}, {"claim": " ", "reason": "r"}]}',
        'Sure: {"answer": "x", "citations": ["p1"]} done',
        '{"abstained": true, "abstention_reason": " none "}',
        '{"answer": "", "citations": ["p1"]}',
        '{"answer": 5, "citations": ["p1"]}',
        '{"answer": "x", "citations": ["zz"]}',
        "[1]",
        "nothing",
        None,
    ]
    df = spark.createDataFrame([(i, r, ["p1", "p2"]) for i, r in enumerate(replies)], "query_id int, raw string, evidence_ids array<string>")
    got = generate.checked_answers(df).orderBy("query_id").collect()
    assert (got[0].answer, got[0].citations, got[0].abstained) == ("yes", ["p1", "p2"], False)
    assert [tuple(c) for c in got[0].supported_claims] == [("c", ["p1"])] and [tuple(c) for c in got[0].unsupported_claims] == [("e", "r")]
    assert (got[1].answer, got[1].citations) == ("x", ["p1"])
    assert (got[2].abstained, got[2].abstention_reason) == (True, "none")
    assert all(r.abstained and r.answer == "" and r.citations == [] for r in got[3:])


def test_engine_end_to_end(spark, raw):
    rows = raw(
        {"question": "capital of France?", "title": "France", "candidates": ["Paris is the capital of France and it was built on a river long ago.", " "], "passage_types": ["paragraph"], "long_answers": ["Paris"]},
        {"question": "where is Berlin?", "title": "Germany", "candidates": ["Berlin is a large town that was founded on the Spree in the north."], "long_answers": ["Spree"]},
        {"title": "Other", "candidates": ["There are many words in this sentence that is about nothing at all."]},
    )
    keys = ("paris", "berlin", "river", "words")
    embedder = lambda: lambda texts: [[float(k in t.lower()) + 0.01 for k in keys] + [0.0] * 60 for t in texts]
    engine = Engine.build(spark, rows, model=embedder)
    q = spark.createDataFrame([(1, "capital of France"), (2, "where is Berlin")], "query_id int, text string")
    q = q.withColumn("dense", F.concat(F.when(F.col("query_id") == 1, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0)))), F.array_repeat(F.lit(0.0), 60)))
    for mode in ("dense", "sparse", "hybrid"):
        top = {r.query_id: r.title for r in engine.retrieve(q, mode, 1).collect()}
        assert top == {1: "France", 2: "Germany"}, mode
    m = engine.evaluate(q.withColumn("text", F.when(F.col("query_id") == 1, "capital of France?").otherwise("where is Berlin?")), k_values=[1])
    assert {r.mode: r.recall_at_k for r in m.collect()} == {"dense": 1.0, "sparse": 1.0, "hybrid": 1.0}
    a = {r.query_id: (r.answer, r.abstained) for r in engine.query(q, "sparse", 2).collect()}
    assert a[1] == ("Paris is the capital of France and it was built on a river long ago.", False)
    engine.client = lambda: lambda prompts: ['{"answer": "no", "citations": ["zz"]}' for _ in prompts]
    assert all(r.abstained for r in engine.query(q, "sparse", 2).collect())
    with pytest.raises(ValueError):
        engine.retrieve(q, "other")
    with pytest.raises(ValueError):
        engine.retrieve(q, "sparse", 0)
    assert engine.describe()["has_points"]


def test_resumed_writes(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    df = spark.createDataFrame([(f"p{i}", i) for i in range(5)], "point_id string, v int")
    assert resume.upsert_missing(df.where("v < 2"), path, "point_id", lambda x: x) == 2
    assert resume.upsert_missing(df, path, "point_id", lambda x: x) == 3
    assert resume.upsert_missing(df, path, "point_id", lambda x: x) == 0
    assert spark.read.parquet(path).count() == 5


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    df = spark.createDataFrame([(f"p{i}", i) for i in range(4)], "point_id string, v int")
    df.where("v < 2").write.parquet(src)
    assert resume.stream_upsert(spark, src, out, ck, lambda x: x.withColumn("w", F.col("v") * 2), "point_id") == 1
    df.write.mode("append").parquet(src)
    resume.stream_upsert(spark, src, out, ck, lambda x: x.withColumn("w", F.col("v") * 2), "point_id")
    assert sorted((r.point_id, r.w) for r in spark.read.parquet(out).collect()) == [(f"p{i}", 2 * i) for i in range(4)]
