"""The engine's surface: build indexes, retrieve, answer, evaluate and describe, as plans over DataFrames."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import MODES, EngineConfig
from siftline.operators import chunking, dense, evaluate, fusion, generate, sparse
from siftline.plans.shared import cut, small

FIELDS = ("group_id", "text", "context_text", "title", "chunk_kind", "passage_types", "source_row_ordinal", "start_candidate_idx", "end_candidate_idx")


class Engine:
    """Chunks, their points and their term weights, asked by batches of queries.

    queries: ``query_id, text`` and, for dense and hybrid modes, ``dense``.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, points: DataFrame | None = None, weights: DataFrame | None = None, config: EngineConfig = EngineConfig(), reranker: Callable | None = None, client: Callable | None = None) -> None:
        self.spark, self.chunks, self.points, self.config, self.reranker, self.client = spark, chunks, points, config, reranker, client
        self.index = None if weights is not None else sparse.build(chunks.select("chunk_id", "text"), config, key="chunk_id")
        self.weights = weights

    @classmethod
    def build(cls, spark: SparkSession, rows: DataFrame, config: EngineConfig = EngineConfig(), model: Callable | None = None, **more) -> Engine:
        """Chunk raw rows and, with a model, embed the chunks."""
        chunks = chunking.chunk(rows, config).drop("span", "part")
        points = None
        if model is not None:
            from siftline.operators.ingest import embedding_text

            texts = chunks.select(F.col("chunk_id").alias("point_id"), embedding_text(F.col("text"), F.col("title")).alias("_t"), F.lit(0).alias("embedded_at"))
            points = dense.embed(texts, "_t", model, config.embed_batch).drop("_t")
        return cls(spark, chunks, points, config=config, **more)

    def _lists(self, queries: DataFrame, mode: str, k: int, known: dict | None = None) -> tuple[DataFrame, str]:
        """The hits of a mode and the name of their rank. known: where the two searches are kept, so that several modes share them."""
        def s():
            if self.index is not None:
                return sparse.search(queries, self.index, k, self.config)
            counts = sparse.document_frequency(self.weights)
            return sparse.ranked(sparse.scores(sparse.query_terms(queries, self.config.analyzer), self.weights.join(counts, "term"), counts), k)

        def v():
            return dense.topk(queries, dense.once(self.points), k, self.config.distance)

        def once(name, make):
            if known is None:
                return make()
            if name not in known:
                known[name] = cut(make())
            return known[name]

        if mode == "sparse":
            return once("sparse", s), "rank"
        if self.points is None:
            raise ValueError("the engine has no points")
        return (once("dense", v), "rank") if mode == "dense" else (fusion.fuse(once("dense", v), once("sparse", s), self.config), "fusion_rank")

    def retrieve(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, known: dict | None = None) -> DataFrame:
        """Final hits with ``final_rank``: over-fetched, fused, reranked if asked for (hybrid only), deduplicated, cut."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if not 1 <= top_k <= 500:
            raise ValueError("top_k must be from 1 to 500")
        c = self.config
        hits, rank = self._lists(queries, mode, max(top_k, c.retrieve_k), known)
        hits = self.chunks.select(F.col("chunk_id").alias("point_id"), *FIELDS).join(small(cut(hits)), "point_id")
        final = top_k
        if mode == "hybrid":
            final = min(top_k, c.rerank_k or top_k)
            if c.rerank_enabled and self.reranker is not None:
                body = fusion.rerank_input(F.col("text"), F.col("context_text"), F.col("title"), c.rerank_context_token_budget)
                asked = hits.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").withColumn("_b", body)
                hits, rank = fusion.rerank(asked, fusion.model_score(self.reranker, "_q", "_b")).drop("_q", "_b"), "rerank_rank"
        if c.dedupe_enabled:
            return fusion.dedupe(hits, rank, final).withColumnRenamed("dedupe_rank", "final_rank")
        return hits.withColumn("final_rank", F.col(rank)).where(F.col(rank) <= final)

    def query(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 10) -> DataFrame:
        """Grounded answers: by the pluggable client if there is one, else the first sentence of the best evidence."""
        hits = self.retrieve(queries, mode, top_k)
        found = generate.evidence(hits, self.config.generation_context_token_budget, "final_rank")
        if self.client is not None:
            prompted = generate.prompts(queries, found)
            replies = generate.complete(prompted.where(F.size("evidence_ids") > 0), self.client).join(prompted.select("query_id", "evidence_ids"), "query_id", "right")
            return generate.checked_answers(replies, self.config.min_citations)
        answers = generate.heuristic(found)
        return queries.select("query_id").join(answers, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), "point_id", F.coalesce("abstained", F.lit(True)).alias("abstained"))

    def evaluate(self, queries: DataFrame, modes=None, k_values=(1, 5, 10, 20), contract: str = "answer_overlap") -> DataFrame:
        """Means of Recall, MRR and NDCG of modes over the queries whose question has gold labels."""
        modes, ks = evaluate.resolve_modes(modes), evaluate.resolve_k(k_values)
        labels = evaluate.gold(self.chunks).join(queries.select("query_id", F.col("text").alias("query")), "query")
        every, lists = None, {}
        for mode in modes:
            hits = self.retrieve(queries, mode, max(ks), lists).select(F.lit(mode).alias("mode"), "query_id", F.col("final_rank").alias("rank"), "point_id", *FIELDS)
            every = hits if every is None else every.unionByName(hits)
        return evaluate.metrics(evaluate.metrics_per_query(every, labels, contract, ks, modes))

    def describe(self) -> dict:
        """Settings and what there is; no secrets are held."""
        return {"config": dataclasses.asdict(self.config), "modes": list(MODES), "has_points": self.points is not None, "has_reranker": self.reranker is not None, "has_client": self.client is not None}
