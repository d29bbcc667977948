"""Candidates of a row to context-aware chunks.

Everything a row needs is in the row, so the whole way from candidates to chunks is expressions over arrays: no shuffle and no
Python. The only sequential part, the packing of candidates into spans, is one fold whose state holds numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.config import EngineConfig
from siftline.functions import text as T
from siftline.functions.folds import collecting
from siftline.functions.ids import CHUNK_NAMESPACE, joined, uuid5
from siftline.operators.ingest import long_answers

#: How far from a candidate, in positions, a text that contains it is looked for.
REACH = 25
SKIPPED = ("boilerplate", "duplicate_child")
STRUCTURAL = ("header", "intro", "list_parent", "table_parent")
DEPENDENT = ("table_child", "list_item", "header", "intro")
CONTEXT_TOKENS = 80
#: Annotations before a span that its context is first looked for in.
NEAR = 64


def first_role(text: Column, kind: Column, tokens: Column) -> Column:
    """The role of a candidate by itself; the first rule that fits."""
    return (
        F.when(T.is_boilerplate(text), "boilerplate")
        .when(T.is_intro(text), "intro")
        .when(kind == "table", F.when(tokens >= 40, "table_parent").otherwise("table_child"))
        .when(kind == "list", F.when(tokens >= 40, "list_parent").otherwise("list_item"))
        .when(kind.isin(*T.HEADER_TYPES), "header")
        .when(T.is_fact(text), F.when(tokens < 60, "short_fact_candidate").otherwise("paragraph"))
        .otherwise("paragraph")
    )


def annotate(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each row with ``anns``: its candidates that aren't blank, with type, tokens, role and the parent that contains them."""
    texts = F.filter(
        F.transform("candidates", lambda c, i: F.struct(i.alias("idx"), T.normalize(c).alias("text"), T.optional(F.get(F.col("passage_types"), i)).alias("ptype"))), lambda a: a["text"] != ""
    )
    counted = lambda a: F.struct(a["idx"].alias("idx"), a["text"].alias("text"), F.lower(a["text"]).alias("low"), a["ptype"].alias("ptype"), T.token_count(a["text"]).alias("tokens"))
    with_role = lambda a: F.struct(*[a[f].alias(f) for f in ("idx", "text", "low", "ptype", "tokens")], first_role(a["text"], a["ptype"], a["tokens"]).alias("role"))
    base = rows.withColumn("_a", F.transform(F.coalesce(texts, F.array().cast("array<struct<idx:int,text:string,ptype:string>>")), counted))
    base = base.withColumn("_a", F.transform("_a", with_role))

    def parent(a: Column, pos: Column) -> Column:
        low = F.greatest(pos - REACH, F.lit(0))
        near = F.slice("_a", low + 1, pos + REACH + 1 - low)
        holds = F.filter(near, lambda c: (c["idx"] != a["idx"]) & (c["tokens"] >= 8) & F.contains(c["low"], a["low"]))
        able = (a["role"] != "boilerplate") & (a["tokens"] <= config.hard_tokens) & (F.length(a["low"]) > 5)
        return F.when(able, F.get(holds, F.lit(0))["idx"])

    found = base.withColumn("_p", F.transform("_a", lambda a, i: parent(a, i)))
    final = F.transform(
        F.arrays_zip("_a", "_p"),
        lambda z: F.struct(
            *[z["_a"][f].alias(f) for f in ("idx", "text", "low", "ptype", "tokens")],
            F.when(z["_p"].isNotNull(), "duplicate_child").otherwise(z["_a"]["role"]).alias("role"),
            z["_p"].alias("parent"),
        ),
    )
    return found.withColumn("anns", final).drop("_a", "_p")


def _inlined(annotated: DataFrame) -> DataFrame:
    # an inner generator would have a filter on its whole array below it, which makes the annotations once more for each of them
    return annotated.select("row_ordinal", F.inline_outer("anns")).where("idx IS NOT NULL")


def candidates_of(annotated: DataFrame) -> DataFrame:
    """The annotations as rows."""
    return _inlined(annotated).drop("low").withColumnRenamed("idx", "candidate_idx").withColumnRenamed("ptype", "passage_type").withColumnRenamed("parent", "parent_candidate_idx")


def compatible(role: Column, kind: Column, tokens: Column, next_kind: Column, next_tokens: Column) -> Column:
    pair = kind.isin(*T.LIST_OR_TABLE) & next_kind.isin(*T.LIST_OR_TABLE)
    return role.isin("header", "intro") | kind.eqNullSafe(next_kind) | F.coalesce(pair, F.lit(False)) | ((tokens <= 30) & (next_tokens <= 30))


def pack(annotated: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each row with ``spans``: for each annotation the number of its span, -1 where it is in none.

    A span is open while it has fewer than the soft limit of tokens. Skipped candidates are swallowed at no cost but are the
    neighbour that the next one is compared with; a candidate that doesn't go with it or would pass the maximum opens the next span.
    """
    state = F.struct(
        F.lit(False).alias("open"), F.lit(0).alias("total"), F.lit(-1).alias("span"), F.lit("").alias("role"), F.lit(None).cast("string").alias("ptype"), F.lit(0).alias("tokens"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, a: Column) -> Column:
        skipped = a["role"].isin(*SKIPPED)
        inside = s["open"] & (s["total"] < config.soft_tokens)
        goes = inside & (skipped | (compatible(s["role"], s["ptype"], s["tokens"], a["ptype"], a["tokens"]) & (s["total"] + a["tokens"] <= config.max_tokens)))
        made = lambda is_open, total, span, at: F.struct(
            is_open.alias("open"), total.cast("int").alias("total"), span.cast("int").alias("span"), a["role"].alias("role"), a["ptype"].alias("ptype"), a["tokens"].alias("tokens"), F.concat(s["out"], F.array(at.cast("int"))).alias("out")
        )
        added = F.when(skipped, s["total"]).otherwise(s["total"] + a["tokens"])
        return (
            F.when(goes, made(F.lit(True), added, s["span"], s["span"]))
            .when(skipped, made(F.lit(False), F.lit(0), s["span"], F.lit(-1)))
            .otherwise(made(F.lit(True), a["tokens"], s["span"] + 1, s["span"] + 1))
        )

    return annotated.withColumn("spans", collecting("anns", state, step))


def runs(spans: str) -> Column:
    """``span, lo, n`` of each span, whose candidates follow each other: its number, where it starts and its length (skipped ones counted)."""
    at = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1)).otherwise(F.array().cast("array<int>"))
    number = lambda i: F.get(F.col(spans), i)
    starts = F.filter(at, lambda i: (number(i) >= 0) & ((i == 0) | (number(i - 1) != number(i))))
    return F.transform(F.arrays_zip(starts.alias("lo"), F.slice(F.concat(starts, F.array(F.size(spans))), 2, 1_000_000_000).alias("hi")), lambda z: F.struct(number(z["lo"]).alias("span"), z["lo"].alias("lo"), (z["hi"] - z["lo"]).alias("n")))


def spans_of(packed: DataFrame) -> DataFrame:
    """The spans as rows: ``row_ordinal, span, lo, members`` (usable ones only); each takes its own slice of the annotations."""
    exploded = packed.withColumn("_runs", runs("spans")).drop("spans").select("*", F.inline_outer("_runs")).where("span IS NOT NULL").drop("_runs")
    return exploded.withColumn("members", F.filter(F.slice("anns", F.col("lo") + 1, F.col("n")), lambda a: ~a["role"].isin(*SKIPPED))).drop("n")


def split_sentences(text: Column, target: int, most: int) -> Column:
    """Sentences packed up to ``most`` tokens; the last one, if short, opens the next part too."""
    overlap = max(10, target // 5)
    state = F.struct(F.array().cast("array<string>").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, sentence: Column) -> Column:
        longer = F.array_join(F.concat(s["cur"], F.array(sentence)), " ")
        full = (F.size(s["cur"]) > 0) & (T.token_count(longer) > most)
        last = F.get(s["cur"], F.size(s["cur"]) - 1)
        kept = F.when(T.token_count(last) <= overlap, F.array(last)).otherwise(F.array().cast("array<string>"))
        return F.when(full, F.struct(F.concat(kept, F.array(sentence)).alias("cur"), F.concat(s["out"], F.array(F.array_join(s["cur"], " "))).alias("out"))).otherwise(
            F.struct(F.concat(s["cur"], F.array(sentence)).alias("cur"), s["out"].alias("out"))
        )

    return F.aggregate(T.sentences(text), state, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["out"]))


def context_of(text: Column, members: Column, anns: Column, lo: Column, config: EngineConfig) -> Column:
    """The text with the run of headings, intros and parents before its span, where it depends on such; capped in words."""
    needs = (T.token_count(text) < config.soft_tokens) | F.exists(members, lambda m: m["role"].isin(*DEPENDENT)) | (F.size(members) > 1)
    state = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("prefix"))

    def step(s: Column, a: Column) -> Column:
        structural = a["role"].isin(*STRUCTURAL)
        longer = F.when(F.contains(text, a["text"]), s["prefix"]).otherwise(F.concat(F.array(a["text"]), s["prefix"]))
        on = F.struct((T.token_count(F.array_join(longer, " ")) >= CONTEXT_TOKENS).alias("done"), longer.alias("prefix"))
        off = F.struct((F.size(s["prefix"]) > 0).alias("done"), s["prefix"].alias("prefix"))
        return F.when(s["done"], s).when(structural, on).otherwise(off)

    fold = lambda before, finish: F.aggregate(F.reverse(before), state, step, finish)
    near = fold(F.slice(anns, F.greatest(lo - NEAR, F.lit(0)) + 1, F.least(lo, F.lit(NEAR))), lambda s: F.when(s["done"] | (lo <= NEAR), F.array_join(s["prefix"], " ")))
    # only where no heading run ended among the nearest is the rest of the row looked at
    prefix = F.coalesce(near, fold(F.slice(anns, F.lit(1), lo), lambda s: F.array_join(s["prefix"], " ")))
    wide = F.when(prefix != "", F.concat(prefix, F.lit(" "), text)).otherwise(text)
    capped = F.when(T.token_count(wide) <= config.context_token_cap, wide).otherwise(T.first_words(wide, config.context_token_cap))
    return F.when(needs, capped).otherwise(text)


def chunk_kind(members: Column) -> Column:
    has = lambda *roles: F.exists(members, lambda m: m["role"].isin(*roles))
    return F.when(has("table_parent", "table_child"), "table_span").when(has("list_parent", "list_item"), "list_span").when(F.size(members) > 1, "minimum_context_span").otherwise("paragraph")


def _merge_tiny(chunks: DataFrame, config: EngineConfig) -> DataFrame:
    """A chunk under the hard limit joins the one before it; such chunks at the row's start are dropped."""
    w = W.partitionBy("source_row_ordinal").orderBy("span", "part")
    tiny = (F.col("token_count") < config.hard_tokens) & (F.col("chunk_kind") != "short_fact")
    isles = chunks.withColumn("_isle", F.sum((~tiny).cast("int")).over(w)).where("_isle > 0")
    first = [c for c in chunks.columns if c not in ("source_row_ordinal", "text", "end_candidate_idx")]
    merged = isles.groupBy("source_row_ordinal", "_isle").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "part", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.max("end_candidate_idx").alias("end_candidate_idx"),
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(c, F.struct("span", "part")).alias(c) for c in first],
    )
    tokens = T.token_count(F.col("text"))
    many = F.col("_n") > 1
    return merged.withColumns({"context_text": F.when(many, F.col("text")).otherwise(F.col("context_text")), "token_count": tokens, "context_token_count": F.when(many, tokens).otherwise(F.col("context_token_count"))}).drop("_isle", "_n")


def _cut(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """The spans with ``pieces`` (part 0 is a whole span) and ``suppressed``, the number of pieces too small to be chunks."""
    spans = spans_of(pack(annotate(rows, config), config))
    joined_text = F.array_join(F.transform("members", lambda m: m["text"]), " ")
    spans = spans.withColumn("_text", joined_text).withColumn("_tokens", T.token_count(F.col("_text")))
    parts = F.transform(split_sentences(F.col("_text"), config.target_tokens, config.max_tokens), lambda t, i: F.struct((i + 1).alias("part"), t.alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("_text").alias("text")))
    keep = lambda p: (T.token_count(p["text"]) >= config.hard_tokens) | ((p["part"] == 0) & T.is_fact(p["text"]))
    every = spans.withColumn("_every", F.when(F.col("_tokens") > config.max_tokens, parts).otherwise(whole))
    kept = every.withColumn("pieces", F.filter("_every", keep))
    return kept.withColumn("suppressed", F.size("_every") - F.size("pieces")).drop("_every", "_text", "_tokens")


def chunk(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All chunks of the rows."""
    spans = _cut(rows, config)
    made = spans.select("*", F.inline_outer("pieces")).where("part IS NOT NULL").withColumn("context_text", context_of(F.col("text"), F.col("members"), F.col("anns"), F.col("lo"), config))
    start, end = F.array_min(F.transform("members", lambda m: m["idx"])), F.array_max(F.transform("members", lambda m: m["idx"]))
    tokens = T.token_count(F.col("text"))
    kind = F.when(F.col("part") > 0, F.concat(F.lit("split_"), F.col("part").cast("string"))).when(tokens < config.soft_tokens, "short_fact").otherwise(chunk_kind(F.col("members")))
    key = joined(config.dataset_name, config.dataset_split, F.col("row_ordinal").cast("string"), start.cast("string"), end.cast("string"), F.left(F.col("text"), F.lit(120)))
    title = T.optional(F.col("title"))
    out = made.select(
        uuid5(CHUNK_NAMESPACE, key).alias("chunk_id"),
        F.concat_ws(":", F.lit(config.dataset_name), F.lit(config.dataset_split), F.col("row_ordinal").cast("string")).alias("group_id"),
        "text",
        "context_text",
        F.col("row_ordinal").alias("source_row_ordinal"),
        start.alias("start_candidate_idx"),
        end.alias("end_candidate_idx"),
        F.filter(F.transform("members", lambda m: m["ptype"]), lambda p: p.isNotNull()).alias("passage_types"),
        title.alias("title"),
        title.alias("source"),
        T.optional(F.col("question")).alias("question"),
        T.optional(F.col("document_url")).alias("document_url"),
        F.lit(None).cast("int").alias("parent_candidate_idx"),
        kind.alias("chunk_kind"),
        tokens.alias("token_count"),
        T.token_count(F.col("context_text")).alias("context_token_count"),
        long_answers(F.col("long_answers")).alias("long_answers"),
        "span",
        "part",
    )
    return _merge_tiny(out, config) if config.soft_tokens < config.hard_tokens else out


def counters(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row of figures of a chunk build, with the roles as a map. All are sums, so one pass and a small shuffle."""
    annotated = annotate(rows, config)
    a = _inlined(annotated)
    roles = a.groupBy("role").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("role_counts"))
    figures = a.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("tokens") <= config.soft_tokens).alias("tiny_candidates"),
        F.count_if(F.col("role") == "boilerplate").alias("boilerplate"), F.count_if(F.col("role") == "duplicate_child").alias("duplicate_children"),
    )
    made = chunk(rows, config)
    built = made.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_kind") == "short_fact").alias("short_facts"), F.count_if(F.col("context_text") != F.col("text")).alias("context_expanded"))
    small = _cut(rows, config).agg(F.coalesce(F.sum("suppressed"), F.lit(0)).alias("tiny_suppressed"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    return total.crossJoin(figures).crossJoin(built).crossJoin(small).crossJoin(roles)  # one row each
