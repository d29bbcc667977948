"""Fusion of rankings, reranking, and deduplication that keeps where the duplicates came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.config import EngineConfig
from siftline.functions import text as T

SEP = "\x1f"


def fuse(dense: DataFrame, sparse: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Weighted reciprocal ranks of two hit lists (``query_id, point_id, score, rank``), one row for each point of either."""
    d = dense.select("query_id", "point_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "point_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    part = lambda weight, rank: F.coalesce(weight / (config.rrf_k + F.col(rank)), F.lit(0.0))
    both = d.join(s, ["query_id", "point_id"], "full_outer").withColumn("fusion_score", part(F.lit(config.dense_weight), "dense_rank") + part(F.lit(config.sparse_weight), "sparse_rank"))
    return both.withColumn("fusion_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fusion_score"), "point_id")))


def rerank_input(text: Column, context: Column, title: Column, budget: int) -> Column:
    """What a reranker reads: the context, if there is one, cut to a number of words, under its title."""
    body = F.coalesce(T.optional(context), text)
    cut = F.when(F.size(T.words(body)) > budget, T.first_words(body, budget)).otherwise(body)
    return F.when(T.optional(title).isNotNull(), F.concat(F.lit("Title: "), T.strip(title), F.lit("\n"), cut)).otherwise(cut)


def rerank(hits: DataFrame, score: Column) -> DataFrame:
    """Ranks hits by a score, null as 0; ties by fusion rank and id."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.coalesce("fusion_rank", F.lit(1_000_000)), "point_id")
    return hits.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(w))


def model_score(model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: str, text: str) -> Column:
    """The score of a pluggable cross-encoder; ``model()`` is called once per worker and gives ``predict(pairs)``."""
    import pandas as pd

    held: dict = {}

    def predict(q, t):
        if "m" not in held:
            held["m"] = model()
        return pd.Series([float(x) for x in held["m"](list(zip(q, t, strict=True)))])

    predict.__annotations__ = {"q": pd.Series, "t": pd.Series, "return": pd.Series}
    return F.pandas_udf(predict, "double")(F.col(query), F.col(text))


def lexical_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct words that the text has."""
    q, t = F.array_distinct(T.tokens_lower(query)), T.tokens_lower(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def dedupe_key(title: Column, context: Column, text: Column) -> Column:
    flat = lambda x: F.coalesce(F.lower(T.normalize(x)), F.lit(""))
    return F.concat(flat(title), F.lit(SEP), flat(F.when(T.optional(context).isNotNull(), context).otherwise(text)))


def body_hash() -> Column:
    """What equal titles and bodies have in common, of ``title, context_text, text``."""
    return F.xxhash64(dedupe_key(F.col("title"), F.col("context_text"), F.col("text"))).alias("body_hash")


def _hash_of(hits: DataFrame) -> Column:
    return F.col("body_hash") if "body_hash" in hits.columns else body_hash()


def dedupe(hits: DataFrame, rank: str, k: int) -> DataFrame:
    """First hit of each title and body by rank; later ones become its aliases, in order. The cut comes after.

    hits: ``query_id, point_id``, a rank, and ``title, context_text, text`` or, so that no texts move, their ``body_hash``; at most the
    candidates of a query are collected.
    """
    key = _hash_of(hits)
    alias = F.struct(F.col(rank).alias("rank"), F.col("point_id").alias("point_id"))
    rest = [c for c in hits.columns if c not in ("query_id", "body_hash")]
    first = hits.withColumn("_k", key).groupBy("query_id", "_k").agg(F.min_by(F.struct(*rest), F.struct(F.col(rank), F.col("point_id"))).alias("h"), F.array_sort(F.collect_list(alias)).alias("_a"))
    w = W.partitionBy("query_id").orderBy(F.col(f"h.{rank}"), F.col("h.point_id"))
    kept = first.withColumn("dedupe_rank", F.row_number().over(w)).where(F.col("dedupe_rank") <= k)
    return kept.select("query_id", "h.*", "dedupe_rank", F.transform(F.slice("_a", 2, 1_000_000), lambda x: x["point_id"]).alias("duplicate_aliases"))


def dedupe_metrics(hits: DataFrame) -> DataFrame:
    """Per query: hits, different ones, dropped ones and their rate."""
    key = _hash_of(hits)
    c = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_count"), F.countDistinct(key).alias("unique_count"))
    dropped = F.col("raw_count") - F.col("unique_count")
    return c.withColumns({"dedupe_drop_count": dropped, "dedupe_drop_rate": dropped / F.col("raw_count")})
