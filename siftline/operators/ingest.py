"""Raw rows to passages, chunk groups to flat chunks and back, caps and counts.

Raw rows have ``row_ordinal``; a null list element counts as missing, and a row of null candidates has no passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.functions import text as T
from siftline.functions.ids import PASSAGE_NAMESPACE, joined, uuid5

GROUP_FIELDS = ("title", "question", "document_url")


def long_answers(answers: Column) -> Column:
    """Answers as a list of texts: null is empty; null elements are dropped."""
    return F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: a.isNotNull())


def explode_passages(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One passage for each candidate that isn't blank, with the type at its position. Narrow: no shuffle."""
    kinds = F.col("passage_types")
    listed = rows.select("*", F.posexplode("candidates").alias("candidate_idx", "_text")).withColumn("_text", T.strip(F.col("_text"))).where("_text <> ''")
    key = joined(config.dataset_name, config.dataset_split, F.col("row_ordinal").cast("string"), F.col("candidate_idx").cast("string"))
    return listed.select(
        uuid5(PASSAGE_NAMESPACE, key).alias("passage_id"),
        F.col("_text").alias("text"),
        "row_ordinal",
        "candidate_idx",
        T.optional(F.col("title")).alias("source"),
        T.optional(F.col("title")).alias("title"),
        T.optional(F.col("question")).alias("question"),
        T.optional(F.get(kinds, F.col("candidate_idx"))).alias("passage_type"),
        T.optional(F.col("document_url")).alias("document_url"),
        long_answers(F.col("long_answers")).alias("long_answers"),
    )


def legacy_passages(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Flat rows as passages; a missing id or text or a blank text is an error of the query."""
    name, text, source = (F.col(f"`{c}`").cast("string") for c in (config.id_field, config.text_field, config.source_field))
    body = T.strip(text)
    checked = F.when(name.isNull(), F.raise_error(F.lit(f"Missing passage id field: {config.id_field}"))).when(text.isNull(), F.raise_error(F.lit(f"Missing passage text field: {config.text_field}")))
    checked = checked.when(body == "", F.raise_error(F.lit("Passage text is empty after stripping"))).otherwise(body)
    none = F.lit(None).cast("string")
    return rows.select(
        name.alias("passage_id"), checked.alias("text"), T.optional(source).alias("source"), T.optional(source).alias("title"), none.alias("question"),
        none.alias("passage_type"), none.alias("document_url"), F.array().cast("array<string>").alias("long_answers"),
    )


def passages_of(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Rows with candidates are exploded, others are taken as flat rows."""
    if "candidates" not in rows.columns:
        return legacy_passages(rows, config)
    nested = explode_passages(rows.where("candidates IS NOT NULL"), config)
    if config.text_field not in rows.columns:
        return nested
    return nested.unionByName(legacy_passages(rows.where("candidates IS NULL"), config), allowMissingColumns=True)


def first_rows(rows: DataFrame, n: int | None, ordinal: str = "row_ordinal") -> DataFrame:
    """The first n rows in the order of their ordinals, which may have gaps."""
    return rows if n is None else rows.orderBy(ordinal).limit(n)


def first_passages(passages: DataFrame, n: int | None) -> DataFrame:
    """The first n passages in the order of rows and candidates."""
    return passages if n is None else passages.orderBy("row_ordinal", "candidate_idx").limit(n)


def _pool(groups: DataFrame) -> DataFrame:
    return groups.withColumn("_at", F.transform(F.filter(F.coalesce("texts", F.array().cast(groups.schema["texts"].dataType)), lambda t: t["text_idx"].isNotNull()), lambda t: t["text_idx"]))


def rejected_references(groups: DataFrame) -> DataFrame:
    """``group_id, chunk_id, field, text_idx``: references of chunks that the group's texts don't have, each once."""
    none = F.array().cast("array<int>")
    each = _pool(groups).select("group_id", "_at", F.inline("chunks")).select(
        "group_id", "chunk_id", "_at", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), none).alias("refs")) for f in ("text_idxs", "context_idxs")]))
    )
    missing = F.array_except(F.filter("refs", lambda i: i.isNotNull()), F.col("_at"))
    return each.select("group_id", "chunk_id", "field", F.explode(missing).alias("text_idx"))


def flatten_groups(groups: DataFrame, missing: str = "skip") -> DataFrame:
    """Chunks of groups with their texts put together from the group's pool.

    A reference without a text gives no text (``missing="skip"``; :func:`rejected_references` tells them) or fails the query (``"raise"``).
    """
    if missing not in ("skip", "raise"):
        raise ValueError(f"unknown treatment {missing!r} of missing references")
    known = F.filter(F.coalesce("texts", F.array().cast(groups.schema["texts"].dataType)), lambda t: t["text_idx"].isNotNull())
    pool = groups.select("group_id", "source_row_ordinal", *GROUP_FIELDS, F.transform(known, lambda t: t["text_idx"]).alias("_at"), F.transform(known, lambda t: t["text"]).alias("_texts"), "chunks")
    rows = pool.select("group_id", "source_row_ordinal", *GROUP_FIELDS, "_at", "_texts", F.inline("chunks"))
    at = lambda i: F.array_position(F.col("_at"), i).cast("int")
    error = lambda i: F.raise_error(F.concat(F.lit("Chunk "), F.coalesce("chunk_id", F.lit("?")), F.lit(" of group "), F.coalesce("group_id", F.lit("?")), F.lit(" refers to a missing text: "), i.cast("string"))).cast("string")
    found = lambda i: F.get(F.col("_texts"), at(i) - 1)
    text = (lambda i: F.when(at(i) == 0, error(i)).otherwise(found(i))) if missing == "raise" else found
    put = lambda refs: F.array_join(F.filter(F.transform(F.coalesce(F.col(refs), F.array().cast("array<int>")), text), lambda x: x.isNotNull()), " ")
    return rows.withColumns({"text": put("text_idxs"), "context_text": put("context_idxs")}).drop("_at", "_texts", "text_idxs", "context_idxs")


def index_records(lines: DataFrame) -> DataFrame:
    """Groups, flat chunks and passages of one source as one table: ``record_kind, point_id, text, context_text, title, question``.

    lines: a table with the union of the three kinds' columns; a line with ``chunks`` is a group, with ``chunk_id`` a chunk.
    """
    have = set(lines.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    parts = []
    if "chunks" in have:
        flat = flatten_groups(lines.where("chunks IS NOT NULL").select("group_id", "source_row_ordinal", *GROUP_FIELDS, "texts", "chunks"))
        parts.append(flat.select(F.lit("group").alias("record_kind"), F.col("chunk_id").alias("point_id"), "text", "context_text", "title", "question"))
    rest = lines.where(col("chunks").isNull())
    if "chunk_id" in have:
        parts.append(rest.where("chunk_id IS NOT NULL").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("point_id"), "text", col("context_text").cast("string").alias("context_text"), "title", "question"))
    if "passage_id" in have:
        parts.append(rest.where(col("chunk_id").isNull() & F.col("passage_id").isNotNull()).select(F.lit("passage").alias("record_kind"), F.col("passage_id").alias("point_id"), "text", F.lit(None).cast("string").alias("context_text"), "title", "question"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


def group_chunks(chunks: DataFrame, rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Flat chunks as groups that store each text once: ``texts`` in the order of first use, ``chunks`` with references.

    A chunk's text is matched with the row's candidates inside its span, then with all of the row's, and else kept whole.
    One shuffle by row; the matching is a fold over the row's own candidates.
    """
    listed = F.transform("candidates", lambda c, i: F.struct(i.alias("raw_idx"), T.normalize(c).alias("text"), T.optional(F.get(F.col("passage_types"), i)).alias("passage_type")))
    own = rows.select(F.col("row_ordinal").alias("source_row_ordinal"), F.filter(listed, lambda c: c["text"] != "").alias("_cands"))
    order = ["start_candidate_idx", "end_candidate_idx", "chunk_id"]
    item = F.struct(*order, "text", "context_text", "passage_types", "parent_candidate_idx", "chunk_kind", "token_count", "context_token_count")
    held = chunks.groupBy("source_row_ordinal").agg(F.array_sort(F.collect_list(item)).alias("_items"), F.first("title").alias("title"), F.first("question").alias("question"), F.first("document_url").alias("document_url"))
    both = held.join(own, "source_row_ordinal", "left")
    none = F.array().cast("array<int>")

    def match(text: Column, candidates: Column) -> Column:
        """Indices of the candidates that, one after another, make up the text; null if they don't."""
        start = F.struct(F.lit(0).alias("at"), none.alias("found"))

        def step(state: Column, c: Column) -> Column:
            prefix = F.when(state["at"] == 0, c["text"]).otherwise(F.concat(F.lit(" "), c["text"]))
            fits = (state["at"] < F.length(text)) & (F.substring(text, state["at"] + 1, F.length(prefix)) == prefix)
            return F.when(fits, F.struct((state["at"] + F.length(prefix)).alias("at"), F.concat(state["found"], F.array(c["raw_idx"])).alias("found"))).otherwise(state)

        return F.aggregate(candidates, start, step, lambda s: F.when(s["at"] == F.length(text), s["found"]))

    def refs(x: Column, field: str) -> Column:
        cands = F.coalesce(F.col("_cands"), F.array().cast("array<struct<raw_idx:int,text:string,passage_type:string>>"))
        inside = F.filter(cands, lambda c: c["raw_idx"].between(x["start_candidate_idx"], x["end_candidate_idx"]))
        # a literal text is a key of its own: index -1 with the text
        hit = F.coalesce(match(x[field], inside), match(x[field], cands))
        key = lambda i: F.struct(i.alias("raw_idx"), F.filter(cands, lambda c: c["raw_idx"] == i)[0]["text"].alias("text"), F.filter(cands, lambda c: c["raw_idx"] == i)[0]["passage_type"].alias("passage_type"))
        literal = F.array(F.struct(F.lit(None).cast("int").alias("raw_idx"), x[field].alias("text"), F.lit(None).cast("string").alias("passage_type")))
        return F.when(hit.isNotNull(), F.transform(hit, key)).otherwise(literal)

    keyed = both.withColumn("_k", F.transform("_items", lambda x: F.struct(x.alias("item"), refs(x, "text").alias("t"), refs(x, "context_text").alias("c"))))
    pooled = keyed.withColumn("_pool", F.array_distinct(F.flatten(F.transform("_k", lambda k: F.concat(k["t"], k["c"])))))
    place = lambda keys: F.transform(keys, lambda k: F.array_position(F.col("_pool"), k).cast("int") - 1)
    made = F.transform(
        "_k",
        lambda k: F.struct(
            k["item"]["chunk_id"].alias("chunk_id"), place(k["t"]).alias("text_idxs"), place(k["c"]).alias("context_idxs"),
            *[k["item"][f].alias(f) for f in ("start_candidate_idx", "end_candidate_idx", "passage_types", "parent_candidate_idx", "chunk_kind", "token_count", "context_token_count")],
        ),
    )
    texts = F.transform("_pool", lambda p, i: F.struct(i.alias("text_idx"), p["text"].alias("text"), p["raw_idx"].alias("raw_idx"), p["passage_type"].alias("passage_type")))
    name = F.concat_ws(":", F.lit(config.dataset_name), F.lit(config.dataset_split), F.col("source_row_ordinal").cast("string"))
    return pooled.select(name.alias("group_id"), "source_row_ordinal", *GROUP_FIELDS, texts.alias("texts"), made.alias("chunks"))


def point_payload(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``point_id, payload``: the stored fields of a point as JSON, nulls and empty answers left out."""
    drop = {key, "source", "indexed_at"}
    fields = [F.when(F.size(c) > 0, F.col(c)).alias(c) if c == "long_answers" else F.col(c) for c in chunks.columns if c not in drop]
    return chunks.select(F.col(key).alias("point_id"), F.to_json(F.struct(*fields)).alias("payload"))


def embedding_text(text: Column, title: Column) -> Column:
    """What is embedded: the text, with the title under it if there is one."""
    return F.when(T.optional(title).isNotNull(), F.concat(text, F.lit("\nTitle: "), T.strip(title))).otherwise(text)
