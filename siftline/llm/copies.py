"""Copies hidden by formatting: progressive partition refinement.

Two texts are the same if they have the same letters and digits in the same sequence, ignoring letter case, whitespace and
punctuation; a text of only ``label: value`` fields (separated by semicolons, bars or line breaks) is the same in any order
of its fields. Accents count, and so do all other characters. A record is one text or a list of texts in any order.

1. Every record gets cheap invariants that no formatting changes: its stripped length, its number of parts and a letter
   histogram. They are counted, and only classes with several members go on.
2. Inside those, the costlier key is made: fields sorted, parts sorted, and a digest of 256 bits of it all.
3. Records of one digest are copies; each copy is put beside the smallest id.

Counting combines before its shuffle. The join back to the classes is salted on the record's side, so a class or a set of
copies that holds a third of all rows is spread over ``SALTS`` tasks; only ids and digests are shuffled after it.

Null texts and null lists take no part; null or blank parts of a list are left out; a list without other parts is the same
as any other such list. Repeated rows are each their own member. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.shared import cut

SALTS = 16
#: Whitespace and punctuation: what formatting may change. ASCII signs count as punctuation.
FORMATTING = r"[\p{P}\p{IsWhite_Space}\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
BLANK = r"(?s)^[\p{IsWhite_Space}]*$"
#: Letters of the histogram: the commonest, which tell texts apart best.
LETTERS = "etanrsil"


def stripped(text: Column) -> Column:
    """The letters, digits and other characters that count, in one letter case (as case folding: ß is ss, ς is σ)."""
    return F.translate(F.replace(F.lower(F.regexp_replace(text, FORMATTING, "")), F.lit("ß"), F.lit("ss")), "ς", "σ")


def part_key(text: Column, may_be_fields: Column) -> Column:
    """The stripped text, or for a text of only fields its stripped fields in order."""
    pieces = F.filter(F.split(text, r"[;|\n\r\u0085  ]"), lambda p: ~p.rlike(BLANK))
    fields = (F.size(pieces) > 1) & F.forall(pieces, lambda p: p.rlike(r"(?s)^[^:]*[\p{L}\p{N}][^:]*:.*[\p{L}\p{N}]"))
    return F.when(may_be_fields & F.contains(text, F.lit(":")) & fields, F.array_join(F.array_sort(F.transform(pieces, stripped)), "")).otherwise(stripped(text))


def members(records: DataFrame) -> DataFrame:
    """``kind, id, digest`` of all records that may have a copy. records: ``kind, id, parts ARRAY<STRING>, may_be_fields BOOLEAN``."""
    records = records.where(F.col("parts").isNotNull() & F.col("id").isNotNull())
    parts = F.filter("parts", lambda p: p.isNotNull() & ~p.rlike(BLANK))
    letters = F.col("_letters")
    cheap = records.select("kind", "id", "may_be_fields", parts.alias("parts")).withColumn("_letters", stripped(F.array_join("parts", "")))
    size = F.length(letters)
    histogram = F.array(*[size - F.length(F.replace(letters, F.lit(x), F.lit(""))) for x in LETTERS])
    cheap = cheap.select("kind", "id", "may_be_fields", "parts", F.xxhash64("kind", size, F.size("parts"), histogram).alias("invariant"))
    classes = cheap.groupBy("invariant").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("invariant")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt")
    spread = classes.select("invariant", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    several = cheap.select("*", salt).join(spread, ["invariant", "_salt"], "left_semi")
    keys = F.array_sort(F.transform("parts", lambda p: part_key(p, F.col("may_be_fields"))))
    ended = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("\u0000"))), "")
    return several.select("kind", "id", F.sha2(ended, 256).alias("digest"))


def copy_sets(known: DataFrame) -> DataFrame:
    """The sets with several members: ``kind, digest, keep_id, copies`` (how many members each had)."""
    return known.groupBy("kind", "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def pairs(known: DataFrame) -> DataFrame:
    """One row for each member but the smallest: ``kind, keep_id, copy_id``."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt")
    sets = copy_sets(known).select("kind", "digest", "keep_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = known.select("kind", "id", "digest", salt).join(sets, ["kind", "digest", "_salt"])
    return joined.where(F.col("id") != F.col("keep_id")).select("kind", "keep_id", F.col("id").alias("copy_id"))


def records_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Raw rows and chunks as records of :func:`members`."""
    a = rows.select(F.lit("row").alias("kind"), F.col("id"), F.col("candidates").alias("parts"), F.lit(True).alias("may_be_fields"))
    b = chunks.where(F.col("text").isNotNull()).select(
        F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.array("text").alias("parts"), (F.coalesce(F.col("chunk_kind"), F.lit("")) == "table_span").alias("may_be_fields")
    )
    return a.unionByName(b)


def find(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Copies among raw rows (by their candidates in any order) and among chunks (by their text)."""
    return pairs(cut(members(records_of(rows, chunks))))


def collapse(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each set of copies once: ``kind, keep_id, copies``; records without a copy are their own set of one."""
    known = cut(members(records_of(rows, chunks)))
    sets = copy_sets(known).select("kind", F.col("keep_id").alias("id"), "copies")
    gone = pairs(known).select("kind", F.col("copy_id").alias("id"))
    every = records_of(rows, chunks).where(F.col("parts").isNotNull() & F.col("id").isNotNull()).select("kind", "id")
    return every.join(gone, ["kind", "id"], "left_anti").join(sets, ["kind", "id"], "left").select("kind", F.col("id").alias("keep_id"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
