"""Evaluation of retrieval: gold labels from answers, five contracts of relevance, Recall, MRR and NDCG at several k.

Labels are a long table (``query, kind, label``), one row each, so a question that a third of all rows ask is no large group.
A label counts once for a query: later hits of the same label are not relevant. Queries without hits count with zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.config import CONTRACTS, MODES
from siftline.functions import text as T

KIND = {"answer_overlap": "answer", "point_id": "point", "group_id": "group", "source_row_ordinal": "row", "candidate_span_overlap": "span"}


def resolve_k(k_values: Sequence[int] | None = None, top_k: int | None = None) -> list[int]:
    """Sorted, each once; at least one, all positive."""
    ks = list(k_values) if k_values is not None else [top_k if top_k is not None else 10]
    if not ks or min(ks) < 1:
        raise ValueError(f"k values must be positive and at least one, got {ks}")
    return sorted(set(ks))


def resolve_modes(modes: Sequence[str] | None = None) -> list[str]:
    chosen = list(modes) if modes else list(MODES)
    if wrong := [m for m in chosen if m not in MODES]:
        raise ValueError(f"unknown retrieval modes {wrong}")
    return list(dict.fromkeys(chosen))


def overlap_text(text: Column, context: Column) -> Column:
    """What answers are looked for in: the text and, if there is one, the context under it; in one letter case."""
    return F.lower(F.when(T.optional(context).isNotNull(), F.concat(text, F.lit("\n"), context)).otherwise(text))


def answers_of(answers: Column) -> Column:
    return F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), T.strip), lambda a: a.isNotNull() & (a != ""))


def is_answer_bearing(text: Column, context: Column, answers: Column) -> Column:
    return F.exists(answers_of(answers), lambda a: F.contains(overlap_text(text, context), F.lower(a)))


def gold(chunks: DataFrame) -> DataFrame:
    """``query, kind, label, row, start, stop``: every gold label of every question, from the chunks that bear an answer."""
    good = chunks.withColumn("query", T.optional(F.col("question"))).where(F.col("query").isNotNull() & is_answer_bearing(F.col("text"), F.col("context_text"), F.col("long_answers")))
    none = F.lit(None).cast("int")
    label = lambda kind, value, start=none, stop=none: F.struct(F.lit(kind).alias("kind"), value.alias("label"), F.col("source_row_ordinal").alias("row"), start.alias("start"), stop.alias("stop"))
    row, a, b = F.col("source_row_ordinal").cast("string"), F.col("start_candidate_idx"), F.col("end_candidate_idx")
    fixed = F.array(label("point", F.col("chunk_id")), label("group", F.col("group_id")), label("row", row), label("span", F.concat_ws(":", row, a.cast("string"), b.cast("string")), a, b))
    answers = F.transform(answers_of(F.col("long_answers")), lambda x: F.struct(F.lit("answer").alias("kind"), x.alias("label"), F.lit(None).cast("bigint").alias("row"), none.alias("start"), none.alias("stop")))
    return good.select("query", F.inline(F.concat(fixed, answers))).where("label IS NOT NULL").distinct()


def cases(labels: DataFrame) -> DataFrame:
    """How many labels of each kind a question has."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}s")
    return labels.groupBy("query").agg(*[count(k) for k in KIND.values()])


def labelled_hits(hits: DataFrame, labels: DataFrame, contract: str) -> DataFrame:
    """Each hit (``mode, query_id, rank``) with the label it is credited with: the first that fits, in sorted order."""
    if contract not in CONTRACTS:
        raise ValueError(f"unknown contract {contract!r}")
    mine = labels.where(F.col("kind") == KIND[contract]).select("query_id", "label", "row", "start", "stop")
    h = hits.select("mode", "query_id", "rank", "point_id", "group_id", F.col("source_row_ordinal").alias("hit_row"), F.col("start_candidate_idx").alias("a"), F.col("end_candidate_idx").alias("b"), overlap_text(F.col("text"), F.col("context_text")).alias("body"))
    same = h["query_id"] == mine["query_id"]
    if contract == "answer_overlap":
        on, order, name = same & F.contains(h["body"], F.lower(mine["label"])), F.col("label"), F.lower(mine["label"])
    elif contract == "candidate_span_overlap":
        on = same & (h["hit_row"] == mine["row"]) & (h["a"] <= mine["stop"]) & (h["b"] >= mine["start"])
        order, name = F.struct("row", "start", "stop"), mine["label"]
    else:
        own = {"point_id": h["point_id"], "group_id": h["group_id"], "source_row_ordinal": h["hit_row"].cast("string")}[contract]
        on, order, name = same & (own == mine["label"]), F.col("label"), mine["label"]
    joined = h.join(mine, on, "inner").select(h["mode"], h["query_id"], h["rank"], order.alias("o"), name.alias("l"))
    return joined.groupBy("mode", "query_id", "rank").agg(F.min_by("l", "o").alias("label"))


def metrics_per_query(hits: DataFrame, labels: DataFrame, contract: str, ks: Sequence[int], modes: Sequence[str]) -> DataFrame:
    """``mode, query_id, k, recall, mrr, ndcg`` for every mode, query with a label, and k."""
    ks = resolve_k(ks)
    name = F.lower("label") if contract == "answer_overlap" else F.col("label")
    relevant = labels.where(F.col("kind") == KIND[contract]).groupBy("query_id").agg(F.countDistinct(name).alias("relevant"))
    credited = labelled_hits(hits, labels, contract)
    first = credited.groupBy("mode", "query_id", "label").agg(F.min("rank").alias("rank"))
    every = labels.select("query_id").distinct().join(relevant, "query_id", "left").select("query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"))
    grid = every.select("query_id", "relevant", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    both = grid.join(first, ["mode", "query_id"], "left").select("mode", "query_id", "relevant", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    inside = F.col("rank") <= F.col("k")
    per = both.groupBy("mode", "query_id", "relevant", "k").agg(
        F.count_if(inside).alias("n"), F.min(F.when(inside, F.col("rank"))).alias("best"), F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("k"), F.col("relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("relevant") > 0
    return per.select(
        "mode", "query_id", "k", F.when(some, F.col("n") / F.col("relevant")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg")
    )


def metrics(per_query: DataFrame) -> DataFrame:
    """Means over queries."""
    return per_query.groupBy("mode", "k").agg(F.count(F.lit(1)).alias("query_count"), F.avg("recall").alias("recall_at_k"), F.avg("mrr").alias("mrr_at_k"), F.avg("ndcg").alias("ndcg_at_k"))


def winners(means: DataFrame) -> DataFrame:
    """For each metric the mode and k of its first maximum, by k and mode."""
    long = means.select("mode", "k", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in ("recall_at_k", "mrr_at_k", "ndcg_at_k")])))
    w = W.partitionBy("metric").orderBy(F.desc("value"), "k", "mode")
    return long.withColumn("r", F.row_number().over(w)).where("r = 1").select("metric", "mode", "k", "value")


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Recall, MRR and NDCG at k of rows with ``ranked`` and ``relevant`` lists of ids."""
    top = F.slice("ranked", 1, k)
    hits = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda r: r.isNotNull())
    n = F.size(F.array_distinct("relevant"))
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), n))))
    return ranked.withColumns({
        "recall": F.when(n > 0, F.size(F.array_intersect(top, F.col("relevant"))) / n).otherwise(0.0), "mrr": F.coalesce(1 / F.array_min(hits), F.lit(0.0)), "ndcg": F.when(n > 0, gain(hits) / ideal).otherwise(0.0)
    })
