"""Six ways to cut rows into chunks, and the figures that compare them.

Works on :func:`study_rows`: a row's candidates that aren't blank and its gold positions, as arrays. Gold positions address
the list without blanks while spans use the original positions. Here a gold position is that of a candidate which holds one
of the row's answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.config import STRATEGIES
from siftline.functions import text as T
from siftline.functions.folds import collecting
from siftline.functions.ids import STUDY_NAMESPACE, joined, uuid5
from siftline.operators import sparse
from siftline.operators.chunking import runs
from siftline.plans.shared import cut, small

CAND = "array<struct<idx:int,text:string,ptype:string,tokens:int,low:string,boiler:boolean,intro:boolean>>"


def study_rows(rows: DataFrame) -> DataFrame:
    """``row_ordinal, title, question, document_url, cands, gold``."""
    texts = F.filter(F.transform("candidates", lambda c, i: F.struct(i.alias("idx"), T.strip(c).alias("text"), T.optional(F.get(F.col("passage_types"), i)).alias("ptype"))), lambda a: a["text"] != "")
    full = F.transform(
        texts,
        lambda a: F.struct(
            a["idx"].alias("idx"), a["text"].alias("text"), a["ptype"].alias("ptype"), T.token_count(a["text"]).alias("tokens"), F.lower(T.normalize(a["text"])).alias("low"),
            T.is_boilerplate(T.normalize(a["text"])).alias("boiler"), T.is_intro_by_words(T.normalize(a["text"])).alias("intro"),
        ),
    )
    answers = F.filter(F.transform(F.coalesce("long_answers", F.array().cast("array<string>")), lambda a: F.lower(T.normalize(a))), lambda a: a != "")
    base = rows.select("row_ordinal", T.optional(F.col("title")).alias("title"), T.optional(F.col("question")).alias("question"), T.optional(F.col("document_url")).alias("document_url"), F.coalesce(full, F.array().cast(CAND)).alias("cands"), answers.alias("_ans"))
    marks = F.transform("cands", lambda c, i: F.when(F.exists("_ans", lambda a: F.contains(c["low"], a)), i))
    return base.withColumn("gold", F.filter(marks, lambda g: g.isNotNull())).drop("_ans")


def _made(df: DataFrame, strategy: str, members: Column | None, kind: str, start: Column, end: Column, text: Column, types: Column, ordinal: Column) -> DataFrame:
    key = joined(strategy, F.col("row_ordinal").cast("string"), start.cast("string"), end.cast("string"), F.left(T.normalize(text), F.lit(120)))
    out = df.select(
        uuid5(STUDY_NAMESPACE, key).alias("chunk_id"), F.lit(strategy).alias("strategy"), "row_ordinal", ordinal.cast("int").alias("ord"), start.alias("start_candidate_idx"), end.alias("end_candidate_idx"), text.alias("text"),
        types.alias("passage_types"), "title", "question", F.lit(kind).alias("chunk_kind"), F.lit(None).cast("string").alias("context_text"), F.lit(None).cast("int").alias("parent_candidate_idx"),
    )
    return out.withColumns({"token_count": T.token_count(F.col("text")), "context_token_count": T.token_count(F.col("text"))})


def _singles(rows: DataFrame, strategy: str, kind: str, keep: Column | None = None) -> DataFrame:
    each = rows.select("*", F.posexplode_outer("cands").alias("_i", "_c")).where("_c IS NOT NULL")
    if keep is not None:
        each = each.where(keep)
    c = F.col("_c")
    return _made(each, strategy, None, kind, c["idx"], c["idx"], c["text"], F.array(c["ptype"]), F.col("_i"))


def raw_candidate(rows: DataFrame) -> DataFrame:
    return _singles(rows, "raw_candidate", "candidate")


def whole_row(rows: DataFrame) -> DataFrame:
    some = rows.where(F.size("cands") > 0)
    idx = F.transform("cands", lambda c: c["idx"])
    text = F.array_join(F.transform("cands", lambda c: c["text"]), "\n")
    return _made(some, "whole_row", None, "row", F.array_min(idx), F.array_max(idx), text, F.array(F.lit("row")), F.lit(0))


def parent_dedup(rows: DataFrame) -> DataFrame:
    """Drops boilerplate and short candidates that an earlier one of at least 40 tokens contains (those are always kept)."""
    c = F.col("_c")
    inside = (c["tokens"] <= 20) & F.exists(F.slice("cands", 1, F.col("_i")), lambda p: (p["tokens"] >= 40) & ~p["boiler"] & F.contains(p["low"], c["low"]))
    return _singles(rows, "parent_dedup", "parent_or_standalone", ~c["boiler"] & ~inside)


def _spans(rows: DataFrame, strategy: str, kind: str) -> DataFrame:
    """The spans (``_s``: the number of each candidate's span, -1 for none) as chunks."""
    each = rows.withColumn("_runs", runs("_s")).select("*", F.inline_outer("_runs")).where("span IS NOT NULL").withColumnRenamed("span", "_i")
    # a slice may end with boilerplate that is in no span
    members = F.filter(F.arrays_zip(F.slice("cands", F.col("lo") + 1, F.col("n")).alias("cands"), F.slice("_s", F.col("lo") + 1, F.col("n")).alias("_s")), lambda z: z["_s"] == F.col("_i"))
    each = each.withColumn("_m", F.transform(members, lambda z: z["cands"])).drop("lo", "n", "_runs")
    idx = F.transform("_m", lambda c: c["idx"])
    text = F.array_join(F.transform(F.filter("_m", lambda c: ~c["boiler"]), lambda c: c["text"]), "\n")
    return _made(each, strategy, None, kind, F.array_min(idx), F.array_max(idx), text, F.transform("_m", lambda c: c["ptype"]), F.col("_i"))


def dpr_window(rows: DataFrame, target: int = 100) -> DataFrame:
    """Windows closed when the next candidate would pass the budget; a single larger one is allowed."""
    state = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("span"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        new = (s["span"] < 0) | (s["total"] + c["tokens"] > target)
        span = F.when(new, s["span"] + 1).otherwise(s["span"])
        return F.struct(F.when(new, c["tokens"]).otherwise(s["total"] + c["tokens"]).alias("total"), span.alias("span"), F.concat(s["out"], F.array(span)).alias("out"))

    return _spans(rows.withColumn("_s", collecting("cands", state, step)), "dpr_window", "fixed_window")


def _packed(rows: DataFrame, least: int, most: int) -> DataFrame:
    none = F.lit(None).cast("string")
    state = F.struct(F.lit(False).alias("open"), F.lit(0).alias("total"), F.lit(-1).alias("span"), none.alias("ptype"), F.lit(0).alias("tokens"), F.lit(False).alias("intro"), F.array().cast("array<int>").alias("out"))

    def goes_with(s: Column, c: Column) -> Column:
        pair = F.coalesce(s["ptype"].isin(*T.LIST_OR_TABLE) & c["ptype"].isin(*T.LIST_OR_TABLE), F.lit(False))
        heads = s["intro"] | F.coalesce(s["ptype"].isin(*T.HEADER_TYPES), F.lit(False))
        return s["ptype"].eqNullSafe(c["ptype"]) | pair | heads | ((c["tokens"] <= 12) & (s["tokens"] <= 30))

    def step(s: Column, c: Column) -> Column:
        inside = s["open"] & (s["total"] < least) & (c["boiler"] | ((s["total"] + c["tokens"] <= most) & goes_with(s, c)))
        made = lambda is_open, total, span, at: F.struct(
            is_open.alias("open"), total.cast("int").alias("total"), span.cast("int").alias("span"), c["ptype"].alias("ptype"), c["tokens"].alias("tokens"), c["intro"].alias("intro"), F.concat(s["out"], F.array(at.cast("int"))).alias("out")
        )
        added = F.when(c["boiler"], s["total"]).otherwise(s["total"] + c["tokens"])
        return (
            F.when(inside, made(F.lit(True), added, s["span"], s["span"]))
            .when(c["boiler"], made(F.lit(False), F.lit(0), s["span"], F.lit(-1)))
            .otherwise(made(F.lit(True), c["tokens"], s["span"] + 1, s["span"] + 1))
        )

    return rows.withColumn("_s", collecting("cands", state, step))


def min_context(rows: DataFrame, least: int = 60, most: int = 220) -> DataFrame:
    return _spans(_packed(rows, least, most), "min_context", "minimum_context_span")


def parent_child(rows: DataFrame) -> DataFrame:
    """Small spans with the row's longest candidate as context (the first of equals)."""
    spans = _spans(_packed(rows, 40, 180), "min_context", "child_with_parent_context")
    longest = F.array_max(F.transform("cands", lambda c: F.struct(c["tokens"].alias("t"), (-c["idx"]).alias("i"), c["text"].alias("x"))))
    parents = rows.select("row_ordinal", longest.alias("_l"))
    with_parent = spans.join(parents, "row_ordinal")
    tokens = T.token_count(F.col("_l.x"))
    return with_parent.withColumns({"strategy": F.lit("parent_child"), "context_text": F.col("_l.x"), "parent_candidate_idx": -F.col("_l.i"), "context_token_count": tokens}).drop("_l")


BUILDERS = {f.__name__: f for f in (raw_candidate, whole_row, dpr_window, parent_dedup, min_context, parent_child)}
assert set(BUILDERS) == set(STRATEGIES)


def build(rows: DataFrame, strategy: str) -> DataFrame:
    """Chunks of one strategy over :func:`study_rows`."""
    if strategy not in BUILDERS:
        raise ValueError(f"unknown strategy {strategy!r}")
    return BUILDERS[strategy](rows)


def build_all(rows: DataFrame) -> DataFrame:
    every = None
    for name in STRATEGIES:
        part = build(rows, name)
        every = part if every is None else every.unionByName(part)
    return every


def with_relevance(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunks with ``relevant``: a gold candidate in the span, or one text inside the other; joined by row, nothing else."""
    gold = rows.select("row_ordinal", "gold", F.transform("gold", lambda g: F.get(F.col("cands"), g)["low"]).alias("_gold_texts"))
    low = F.lower(T.normalize(F.col("text")))
    near = F.exists("gold", lambda g: (F.col("start_candidate_idx") <= g) & (g <= F.col("end_candidate_idx")))
    same = F.exists("_gold_texts", lambda t: (t != "") & (F.contains(t, F.col("_low")) | F.contains(F.col("_low"), t)))
    return chunks.join(gold, "row_ordinal").withColumn("_low", low).withColumn("relevant", near | same).drop("gold", "_gold_texts", "_low")


def quantile(values: Column, share: float) -> Column:
    """The element at the rounded-down place of the sorted list."""
    return F.get(values, F.floor(F.size(values) * share).cast("int"))


def value_at(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Those quantiles without a list of all values: one count for each different value, then a running sum over them."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(value)  # different token counts only
    run = counts.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(W.partitionBy())})
    return run.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col(value))).alias(name) for name, share in shares.items()])


QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def dataset_profile(rows: DataFrame) -> DataFrame:
    """One row of figures of the study's rows."""
    c = rows.select("row_ordinal", F.inline_outer("cands")).where("idx IS NOT NULL")
    per_row = rows.agg(F.count(F.lit(1)).alias("sample_rows"), F.coalesce(F.sum(F.size("cands")), F.lit(0)).alias("total_candidates"), F.coalesce(F.round(F.avg(F.size("cands")), 4), F.lit(0.0)).alias("avg_candidates"), F.coalesce(F.median(F.size("cands")), F.lit(0.0)).alias("median_candidates"))
    short = c.agg(*[F.count_if(F.col("tokens") <= n).alias(f"short_{n}") for n in (3, 5, 10, 20)])
    quantiles = value_at(c, "tokens", QUANTILES)
    gold = rows.select(F.explode_outer(F.transform("gold", lambda g: F.get(F.col("cands"), g)["tokens"])).alias("tokens")).where("tokens IS NOT NULL")
    gold_figures = gold.agg(F.count(F.lit(1)).alias("gold_count"), F.coalesce(F.round(F.avg("tokens"), 4), F.lit(0.0)).alias("gold_token_avg"), F.coalesce(F.median("tokens"), F.lit(0.0)).alias("gold_token_median"))
    return per_row.crossJoin(short).crossJoin(quantiles).crossJoin(gold_figures).crossJoin(nested_ratio(rows))  # one row each


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.inline_outer("cands")).where("idx IS NOT NULL").groupBy(F.coalesce("ptype", F.lit("<missing>")).alias("passage_type")).agg(F.count(F.lit(1)).alias("n"))


def nested_ratio(rows: DataFrame) -> DataFrame:
    """Of candidates over 80 tokens the share with a short one inside them among the next 24."""
    each = rows.select("cands", F.posexplode_outer("cands").alias("i", "c")).where(F.col("c.tokens") > 80)
    child = F.exists(F.slice("cands", F.col("i") + 2, 24), lambda x: (x["tokens"] <= 20) & (F.length(x["low"]) > 5) & F.contains(F.col("c.low"), x["low"]))
    return each.agg(F.coalesce(F.round(F.avg(child.cast("double")), 4), F.lit(0.0)).alias("nearby_nested_parent_ratio"))


def duplicate_like(chunks: DataFrame) -> DataFrame:
    """``strategy, duplicate_like_ratio``: chunks of over 5 characters that contain or are in an earlier one of their row.

    The texts of a row are one array per strategy, so no pairs are made; rows are bounded by their source row.
    """
    low = F.lower(T.normalize(F.col("text")))
    listed = chunks.select("strategy", "row_ordinal", F.struct(F.col("ord"), low.alias("low")).alias("x")).groupBy("strategy", "row_ordinal").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    flags = F.transform("xs", lambda x, i: (F.length(x["low"]) > 5) & F.exists(F.slice("xs", 1, i), lambda y: F.contains(y["low"], x["low"]) | F.contains(x["low"], y["low"])))
    sums = listed.select("strategy", F.size("xs").alias("n"), F.size(F.filter(flags, lambda f: f)).alias("d")).groupBy("strategy").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return sums.select("strategy", F.round(F.col("d") / F.col("n"), 4).alias("duplicate_like_ratio"))


def strategy_profile(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Structural figures of each strategy."""
    rel = with_relevance(chunks, rows)
    main = rel.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.median("token_count").alias("median_tokens"), F.count_if(F.col("token_count") <= 10).alias("tiny_chunks_le_10"),
        F.count_if(F.col("token_count") <= 20).alias("tiny_chunks_le_20"), F.count_if(F.col("token_count") > 300).alias("huge_chunks_gt_300"), F.count_if("relevant").alias("relevant_chunks"),
        F.coalesce(F.median(F.when(F.col("relevant"), F.col("token_count"))), F.lit(0.0)).alias("relevant_token_median"),
    )
    return main.join(duplicate_like(chunks), "strategy")


#: A chunk's place in the corpus is its row's ordinal times this and its own; int64 holds ordinals up to 2 ** 32.
PLACES = 1 << 31


def proxy_hits(queries: DataFrame, chunks: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``strategy, query_id, rank`` and the chunk, of the best k chunks of each strategy by BM25 over Unicode words.

    No pair of a query and a chunk that isn't among a task's best k is written (:func:`siftline.operators.sparse.search`).
    Zero scores count: queries with fewer than k scored chunks are filled with the first chunks in corpus order.
    """
    order = ["row_ordinal", "ord"]
    place = (F.col("row_ordinal") * PLACES + F.col("ord")).alias("place")
    asked, vectors = sparse.different(queries, "unicode")
    words = asked.select("query_id", F.explode("terms.term").alias("term"))
    best = None
    for name in sorted(r.strategy for r in chunks.select("strategy").distinct().collect()):  # of STRATEGIES
        mine = chunks.where(F.col("strategy") == name)
        built = sparse.build(mine.select(place, "text"), analyzer="unicode", key="place")
        scored = sparse.search_different(asked, vectors, built, k).select("query_id", F.col("point_id").alias("place"), "score")
        # the first 2k chunks stand in for those that share no word, beside what is scored
        first = small(cut(mine.select(place, *order, "text").orderBy(*order).limit(2 * k)))
        weighted = sparse.tokenized(first, "unicode", "place").select(F.col("doc_id").alias("place"), F.explode("tokens").alias("term")).distinct().join(built.idf.where("idf <> 0"), "term")
        shared = words.join(small(cut(weighted.select("place", "term"))), "term").select("place", "query_id").distinct()
        filler = queries.select("query_id").crossJoin(first.select("place")).join(shared, ["place", "query_id"], "left_anti").select("query_id", "place", F.lit(0.0).alias("score"))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "place")
        top = scored.unionByName(filler).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        top = top.select(F.lit(name).alias("strategy"), "query_id", F.shiftright("place", 31).alias("row_ordinal"), F.pmod("place", F.lit(PLACES)).cast("int").alias("ord"), "score", "rank")
        best = top if best is None else best.unionByName(top)
    if best is None:
        best = chunks.crossJoin(queries.select("query_id")).select("strategy", "query_id", *order, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    own = chunks.select("strategy", "chunk_id", *order, "text", "start_candidate_idx", "end_candidate_idx", F.col("context_token_count").alias("tokens"))
    return with_relevance(cut(best).join(own, ["strategy", *order]), rows).drop("text", "start_candidate_idx", "end_candidate_idx")


def proxy_metrics(hits: DataFrame, k: int = 10, budgets: tuple[int, ...] = (512, 1024, 2048)) -> DataFrame:
    """Means over the queries of each strategy: hit rate, precision, MRR, NDCG (ideal of one), token density, budget recall."""
    w = W.partitionBy("strategy", "query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = hits.withColumn("used", F.sum("tokens").over(w))
    rel = F.col("relevant")
    per = run.groupBy("strategy", "query_id").agg(
        F.max(rel.cast("double")).alias("recall"), (F.count_if(rel) / k).alias("precision"), F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(rel, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.sum(F.when(rel, F.col("tokens")).otherwise(0)) / F.nullif(F.sum("tokens"), F.lit(0)), F.lit(0.0)).alias("density"),
        *[F.max((rel & (F.col("used") <= b)).cast("double")).alias(f"budget_{b}") for b in budgets],
    )
    names = ["recall", "precision", "mrr", "ndcg", "density", *[f"budget_{b}" for b in budgets]]
    return per.groupBy("strategy").agg(F.count(F.lit(1)).alias("query_count"), *[F.avg(n).alias(n) for n in names])


def study_queries(rows: DataFrame, every: int = 20) -> DataFrame:
    """The stated query set: rows with a question and gold whose ordinal is divisible by ``every``."""
    return rows.where(F.col("question").isNotNull() & (F.size("gold") > 0) & (F.col("row_ordinal") % every == 0)).select(F.col("row_ordinal").alias("query_id"), F.col("question").alias("text"))


def examples(chunks: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """The first n relevant chunks, shortened for display."""
    return with_relevance(chunks, rows).where("relevant").orderBy("row_ordinal", "ord").limit(n).select("chunk_id", "row_ordinal", "ord", T.display(F.col("text")).alias("text"))
