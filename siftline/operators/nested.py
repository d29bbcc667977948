"""Deeply nested records as related flat tables (structural-variant tables).

A bottom-up tree automaton walks a record along its schema and gives every value a state: ``n`` null, ``b`` blank text,
``v`` any other scalar, ``e`` an empty list, ``[..]`` a list of values in the states named, ``{..}`` a struct by field.
Equal states mean equal shape, however many elements a list has, so a finite set of states describes any number of records.
The state of a child is its *variant*. :func:`child_table` puts the children of a list in one typed table, with the
parent's key and the position as supertype keys; :func:`route` splits it by variant into subtype tables of only the
columns that variant has.

Everything is an expression over one row: no shuffle, no Python.
Null lists and records give no children; null elements keep their position and have the state ``n``; parent columns of the
same name as a child field are kept apart by a prefix; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blank means empty or only spaces, tabs and line breaks.
BLANK = r"^[ \t\r\n]*$"


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def state(value: Column, kind: T.DataType) -> Column:
    """The automaton's state of a value, as text."""
    if isinstance(kind, T.StringType):
        return F.when(value.isNull(), "n").when(value.rlike(BLANK), "b").otherwise("v")
    if isinstance(kind, T.ArrayType):
        inner = F.array_sort(F.array_distinct(F.transform(value, lambda x: state(x, kind.elementType))))
        return F.when(value.isNull(), "n").when(F.size(value) == 0, "e").otherwise(F.concat(F.lit("["), F.array_join(inner, "|"), F.lit("]")))
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}:"), state(value[f.name], f.dataType)) for f in kind.fields]
        return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    return F.when(value.isNull(), "n").otherwise("v")


def with_variant(df: DataFrame, columns: Iterable[str], name: str = "variant") -> DataFrame:
    """Each record with the state of the named columns together."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn(name, F.concat_ws(";", *[F.concat(F.lit(f"{c}="), state(F.col(f"`{c}`"), kinds[c])) for c in columns]))


def variant_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """How many records there are of each shape (``variant``, ``records``)."""
    return with_variant(df, columns).groupBy("variant").agg(F.count(F.lit(1)).alias("records"))


def child_table(df: DataFrame, key: str, column: str, parent: str = "parent_id", pos: str = "pos") -> DataFrame:
    """The elements of a list as rows: parent key, position from 0, the element's fields and its variant."""
    kind = df.schema[column].dataType
    assert isinstance(kind, T.ArrayType), column
    rows = df.select(F.col(f"`{key}`").alias(parent), F.posexplode(f"`{column}`").alias(pos, "_x"))
    x, element = F.col("_x"), kind.elementType
    own = {parent, pos, "variant"}
    named = lambda n: f"{column}_{n}" if n in own else n
    fields = [x[f.name].alias(named(f.name)) for f in element.fields] if isinstance(element, T.StructType) else [x.alias("value")]
    return rows.select(parent, F.col(pos).cast("bigint").alias(pos), *fields, state(x, element).alias("variant"))


def route(children: DataFrame, subtypes: Mapping[str, tuple[Column, list[str]]], keys: Iterable[str] = ("parent_id", "pos")) -> dict[str, DataFrame]:
    """Typed subtype tables of a child table: for each name, the rows of its variants with the supertype keys and its own columns."""
    return {name: children.where(test).select(*keys, *columns) for name, (test, columns) in subtypes.items()}


def once(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the latest by ``order``: records sent again count once.

    The aggregate combines before the shuffle, so a key that holds a third of all rows is one row per task there.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{order}`")).alias("_r")
    return df.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(newest).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def _ints(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<int>")), lambda v: v.isNotNull())


#: Pair states (candidate, type; ``-`` where the list ends) that lack a counterpart, and the child each of them is.
UNMATCHED = {"v-": "candidate", "vn": "candidate", "vb": "candidate", "-v": "type"}


def row_orphans(rows: DataFrame) -> DataFrame:
    """Candidates without a type and types without a candidate, position by position (``parent_id, child, child_pos, text_idx``).

    The states of a candidate and its type make the state of their position, and the set of those is the row's variant.
    Only rows of a variant with an unmatched pair are routed on and exploded.
    """
    text = T.StringType()
    states = [F.coalesce(F.transform(c, lambda x: state(x, text)), F.array().cast("array<string>")) for c in ("candidates", "passage_types")]
    known = rows.select(F.col("id").alias("parent_id"), states[0].alias("_c"), states[1].alias("_t"))
    longest = F.greatest(F.size("_c"), F.size("_t"))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda c, i: F.coalesce(F.get(F.col(c), i), F.lit("-"))
    paired = known.select("parent_id", F.transform(places, lambda i: F.concat(at("_c", i), at("_t", i))).alias("_p"))
    routed = paired.where(F.arrays_overlap("_p", F.array(*map(F.lit, UNMATCHED))))
    child = F.create_map(*[F.lit(x) for pair in UNMATCHED.items() for x in pair])[F.col("_s")]
    return (
        routed.select("parent_id", F.posexplode("_p").alias("_i", "_s"))
        .where(F.col("_s").isin(*UNMATCHED))
        .select("parent_id", child.alias("child"), F.col("_i").cast("bigint").alias("child_pos"), F.lit(-1).cast("bigint").alias("text_idx"))
    )


def group_orphans(groups: DataFrame) -> DataFrame:
    """References to texts that a group lacks and texts that no chunk refers to.

    Works row by row; a group that was sent again has the same orphans, so only these few rows are made distinct.
    """
    chunks = F.coalesce(F.col("chunks"), F.array().cast(groups.schema["chunks"].dataType))
    texts = _ints(F.transform("texts", lambda t: t["text_idx"]))
    row = lambda child, at, idx: F.struct(F.lit(child).alias("child"), at.cast("bigint").alias("child_pos"), idx.cast("bigint").alias("text_idx"))
    missing = lambda field, child: F.flatten(
        F.transform(
            F.filter(F.transform(chunks, lambda c, k: F.struct(k.alias("k"), c[field].alias("refs"))), lambda x: state(x["refs"], T.ArrayType(T.IntegerType())).startswith("[")),
            lambda x: F.transform(F.array_except(_ints(x["refs"]), F.col("_texts")), lambda v: row(child, x["k"], v)),
        )
    )
    used = F.concat(F.flatten(F.transform(chunks, lambda c: _ints(c["text_idxs"]))), F.flatten(F.transform(chunks, lambda c: _ints(c["context_idxs"]))))
    unused = F.transform(F.array_except(F.col("_texts"), used), lambda v: row("text", F.lit(-1), v))
    return (
        groups.where(F.col("group_id").isNotNull())
        .select("group_id", "chunks", texts.alias("_texts"))
        .select(F.col("group_id").alias("parent_id"), F.concat(missing("text_idxs", "text_ref"), missing("context_idxs", "context_ref"), unused).alias("_f"))
        .where(F.size("_f") > 0)
        .select("parent_id", F.inline("_f"))
        .dropDuplicates()
    )


def orphans(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """All children without counterpart of both record kinds."""
    return row_orphans(rows).unionByName(group_orphans(groups))


def chunk_subtypes(groups: DataFrame, nulls: bool = False) -> dict[str, DataFrame]:
    """The chunks of the groups in typed tables: with context of their own, without, and with a parent candidate; if asked for, null elements too."""
    kind = groups.schema["chunks"].dataType.elementType
    chunks = child_table(once(groups.select("group_id", "chunks", "written_at"), "group_id", "written_at"), "group_id", "chunks")
    base = [f.name for f in kind.fields if f.name not in ("context_idxs", "parent_candidate_idx")]
    plain = F.col("variant").rlike(r"context_idxs:[ne],")
    child = F.col("variant").contains("parent_candidate_idx:v")
    lost = F.col("variant") == "n"
    subtypes = {
        "plain": (plain & ~child & ~lost, base),
        "contextual": (~plain & ~child & ~lost, [*base, "context_idxs"]),
        "child": (child & ~lost, [*base, "context_idxs", "parent_candidate_idx"]),
    }
    return route(chunks, {**subtypes, "null": (lost, [])} if nulls else subtypes)


def references(groups: DataFrame) -> DataFrame:
    """Every reference of a chunk to a text: parent, chunk position, list, place in the list, text, and whether the text is there."""
    latest = once(groups.select("group_id", "texts", "chunks", "written_at"), "group_id", "written_at")
    texts = _ints(F.transform("texts", lambda t: t["text_idx"]))
    chunks = latest.select("group_id", texts.alias("_texts"), F.posexplode("chunks").alias("chunk_pos", "_c"))
    field = lambda name: F.transform(F.col("_c")[name], lambda v, i: F.struct(F.lit(name).alias("list"), i.alias("ref_pos"), v.alias("text_idx")))
    none = F.array().cast("array<struct<list:string,ref_pos:int,text_idx:int>>")
    both = F.concat(F.coalesce(field("text_idxs"), none), F.coalesce(field("context_idxs"), none))
    return chunks.select("group_id", "chunk_pos", "_texts", F.inline(both)).select(
        F.col("group_id").alias("parent_id"), F.col("chunk_pos").cast("bigint").alias("chunk_pos"), "list",
        F.col("ref_pos").cast("bigint").alias("ref_pos"), "text_idx", F.coalesce(F.array_contains("_texts", F.col("text_idx")), F.lit(False)).alias("found"),
    )
