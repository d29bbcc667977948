"""A mixture of sources at target weights: hash-threshold histograms.

Sizes are tokens. The mixture's size is the largest at which every source that has documents gets exactly its share without
being repeated more often than it may (or ``total`` tokens, if given; a source that can't supply its share then gives all it
may). Shares of sources without documents go to the others in proportion.

A source gives every document ``floor(need / size)`` times and some once more: those whose hash is under its threshold.
Thresholds are found without sorting: tokens are summed by source and hash bucket, the bucket in which the need is met is the
boundary, and only the rows in it are summed again by the next bits of the hash. After the last bits the boundary is one
document (or ones of equal hash), which is taken if that comes nearer to the need. Thresholds are nested: a smaller need
takes a subset of what a larger one takes.

Aggregates combine before their shuffle, so a source with a third of all rows is no hot key. Null or unknown sources stay
out; null and empty texts have no tokens and are kept with their source (at the whole repeats and under the threshold);
targets that are null or not positive give nothing. Targets have one row a source; repeated ones are combined (largest share).
Repeated documents are each their own; empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.encode import count_tokens
from siftline.plans.shared import cut, small

#: Bits of the hash that one histogram takes, and how many histograms there are at most.
BITS, LEVELS = 12, 5
SEED = 20_240_611


def place(*key: Column) -> Column:
    """A document's place from 0 to 2^60 - 1, as good as random."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(SEED)), 4)


def sized(docs: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``source, place, tokens`` of the documents whose source has a target."""
    usable = small(targets.where("target_share > 0").select("source").distinct())
    mine = docs.where(F.col("source").isNotNull()).join(usable, "source", "left_semi")
    return count_tokens(mine.select("source", place(F.col(f"`{key}`")).alias("place"), "text"), ["source", "place"])


def needs(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row for each source with a target: its size, need in tokens, whole repeats and the rest to be met by a threshold."""
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("documents"))
    wanted = targets.where("target_share > 0 AND source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    both = wanted.join(have, "source", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    most = F.col("size") * F.col("max_repeats")
    live = F.when(most > 0, F.col("target_share"))
    figures = both.agg(F.sum(live).alias("_live"), F.min(most / live).alias("_per_share"))
    share = F.when(most > 0, F.col("target_share") / F.nullif(F.col("_live"), F.lit(0.0))).otherwise(0.0)
    size = F.lit(float(total)) if total is not None else F.col("_per_share") * F.col("_live")
    need = F.least(F.coalesce(share * size, F.lit(0.0)), most.cast("double"))
    whole = F.when(F.col("size") > 0, F.floor(need / F.nullif(F.col("size"), F.lit(0)) + 1e-12)).otherwise(0)
    return both.crossJoin(F.broadcast(figures)).select(  # one row of figures
        "source", "target_share", "max_repeats", "size", "documents", need.alias("need"), whole.cast("int").alias("whole"), F.greatest(need - whole * F.col("size"), F.lit(0.0)).alias("rest")
    )


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, threshold``: documents at a place under it are taken once more."""
    edge = small(wanted.select("source", "rest", F.lit(0).cast("bigint").alias("low")))
    rows = sizes
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        width = 1 << shift
        bucket = F.shiftright("place", shift)
        inside = rows.join(small(edge.select("source", "low")), "source").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(width << BITS)))
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        w = W.partitionBy("source").orderBy("bucket")  # at most 2^BITS rows for each source
        summed = histogram.withColumn("upto", F.sum("tokens").over(w)).join(edge.select("source", "rest"), "source")
        crossed = summed.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), "tokens", "n"), "bucket").alias("b"))
        # a source whose rest is nothing but whole buckets has no crossing: everything in the window is taken
        edge = cut(
            edge.join(crossed, "source", "left").select(
                "source",
                (F.col("rest") - F.coalesce(F.col("b.before"), F.lit(0))).alias("rest"),
                F.coalesce(F.shiftleft(F.col("b.bucket"), shift), F.col("low") + F.lit((width << BITS) - width)).alias("low"),
                F.col("b.tokens").alias("boundary"),
                F.coalesce(F.shiftleft(F.col("b.bucket") + 1, shift), F.col("low") + F.lit(width << BITS)).alias("high"),
                F.coalesce(F.col("b.n"), F.lit(0)).alias("n"),
            )
        )
        if not edge.where("n > 1").head(1):  # every boundary is one document
            break
    last = F.when(F.coalesce("boundary", F.lit(0)) < 2 * F.col("rest"), F.col("high")).otherwise(F.col("low"))
    return edge.select("source", last.alias("threshold"))


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The table of sources with whole repeats and threshold, and the sizes it rests on."""
    sizes = cut(sized(docs, targets, key))
    wanted = cut(needs(sizes, targets, total))
    return small(cut(wanted.join(thresholds(sizes, wanted), "source"))), sizes


def _copies() -> Column:
    extra = (F.col("place") < F.col("threshold")) & (F.col("whole") < F.col("max_repeats"))
    return F.col("whole") + extra.cast("int")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id") -> DataFrame:
    """The mixture: each document as often as it is taken (``copy_no`` from 1), with its text; only filters, nothing is sorted."""
    table, _ = plan(docs, targets, total, key)
    taken = docs.select(key, "source", "text", place(F.col(f"`{key}`")).alias("place")).join(table, "source").withColumn("_n", _copies()).where("_n > 0")
    return taken.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "text")


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id") -> DataFrame:
    """What each source gives: target and actual share, tokens, documents taken and the most often one is repeated."""
    table, sizes = plan(docs, targets, total, key)
    given = sizes.join(table.select("source", "whole", "threshold", "max_repeats"), "source").withColumn("_n", _copies())
    sums = given.groupBy("source").agg(F.sum(F.col("tokens") * F.col("_n")).alias("tokens"), F.sum((F.col("_n") > 0).cast("bigint")).alias("documents"), F.max("_n").alias("repeats"))
    all_sources = table.select("source", "target_share").join(sums, "source", "left")
    whole = sums.agg(F.sum("tokens").alias("_all"))
    tokens = F.coalesce("tokens", F.lit(0))
    return all_sources.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(tokens / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("actual_share"), tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats", F.lit(0)).alias("repeats")
    )
