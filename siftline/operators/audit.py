"""Audit of raw candidates: runs of flat passages, neighbouring fragments, and texts that many rows repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions import text as T


def cleaned(rows: DataFrame) -> DataFrame:
    """``row_ordinal, candidate_idx, text`` of candidates that aren't blank."""
    each = rows.select("row_ordinal", F.posexplode("candidates").alias("candidate_idx", "text"))
    return each.withColumn("text", T.strip(F.col("text"))).where("text <> ''")


def continuity_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of neighbours among a row's candidates, marked if the right one seems to go on from the left one."""
    w = W.partitionBy("row_ordinal").orderBy("candidate_idx")
    nxt = cleaned(rows).withColumns({"right_idx": F.lead("candidate_idx").over(w), "right_text": F.lead("text").over(w)}).where("right_idx IS NOT NULL")
    likely = T.is_intro_fragment(F.col("text")) & T.is_followup_fragment(F.col("right_text"))
    return nxt.select("row_ordinal", F.col("candidate_idx").alias("left_idx"), "right_idx", likely.alias("likely"))


def continuity_summary(rows: DataFrame) -> DataFrame:
    """One row of counts and the share of likely continuations."""
    pairs = continuity_pairs(rows).agg(F.count(F.lit(1)).alias("adjacent_pairs"), F.count_if("likely").alias("likely_continuations"))
    base = rows.agg(F.count(F.lit(1)).alias("scanned_rows"), F.count("candidates").alias("rows_with_candidates"))
    total = cleaned(rows).agg(F.count(F.lit(1)).alias("total_candidates"))
    ratio = F.when(F.col("adjacent_pairs") > 0, F.col("likely_continuations") / F.col("adjacent_pairs")).otherwise(0.0)
    return base.crossJoin(total).crossJoin(pairs).withColumn("likely_ratio", ratio)  # one row each


def duplicate_text_groups(rows: DataFrame) -> DataFrame:
    """Exact texts that occur at least twice and in at least two rows."""
    found = cleaned(rows).groupBy("text", "row_ordinal").agg(F.count(F.lit(1)).alias("n")).groupBy("text").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_rows"))
    return found.where("distinct_rows >= 2")


def contiguous_groups(passages: DataFrame, order: str, block: str | None = None) -> DataFrame:
    """Runs of neighbours with equal title, question and URL as pseudo-rows: ``group_no`` from 0, first and last, size.

    A change is where a field differs, null-safe, from the row before; runs are numbered by the number of changes so far.
    Ranges of the order are numbered side by side and only their counts are summed along the order.
    """
    fields = ["title", "question", "document_url"]
    blocks = passages.select(*fields, F.col(order).alias("_o")).withColumn("_b", F.floor(F.col("_o") / 4096))
    w = W.partitionBy("_b").orderBy("_o")
    last = blocks.groupBy("_b").agg(F.max_by(F.struct(*fields), "_o").alias("_last"))
    carried = last.select((F.col("_b")).alias("_pb"), "_last").withColumn("_b", F.lead("_pb").over(W.orderBy("_pb"))).select("_b", "_last")  # one row for each block
    marked = blocks.join(carried, "_b", "left").withColumn("_prev", F.coalesce(F.lag(F.struct(*fields)).over(w), F.col("_last")))
    same = F.col("_prev").isNotNull()
    for f in fields:
        same = same & F.col(f"_prev.{f}").eqNullSafe(F.col(f))
    marked = marked.withColumn("_new", (~same).cast("int")).withColumn("_n", F.sum("_new").over(w))
    before = marked.groupBy("_b").agg(F.sum("_new").alias("_c")).withColumn("_before", F.sum("_c").over(W.orderBy("_b")) - F.col("_c"))
    numbered = marked.join(before.select("_b", "_before"), "_b").withColumn("group_no", F.col("_before") + F.col("_n") - 1)
    return numbered.groupBy("group_no").agg(F.min("_o").alias("first_row"), F.max("_o").alias("last_row"), F.count(F.lit(1)).alias("members"), *[F.min(f).alias(f) for f in fields])
