"""JSON Lines sources. Lines keep their order as dense ordinals, whatever the splits of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = "id STRING, text STRING, question STRING, title STRING, candidates ARRAY<STRING>, passage_types ARRAY<STRING>, long_answers ARRAY<STRING>, document_url STRING"
PASSAGE = "passage_id STRING, text STRING, source STRING, title STRING, question STRING, passage_type STRING, document_url STRING, long_answers ARRAY<STRING>"
CHUNK = (
    "chunk_id STRING, group_id STRING, text STRING, context_text STRING, source_row_ordinal BIGINT, start_candidate_idx INT, end_candidate_idx INT, passage_types ARRAY<STRING>, title STRING, source STRING, question STRING, "
    "document_url STRING, parent_candidate_idx INT, chunk_kind STRING, token_count INT, context_token_count INT, long_answers ARRAY<STRING>"
)
GROUPED = (
    "texts ARRAY<STRUCT<text_idx:INT,text:STRING,raw_idx:INT,passage_type:STRING>>, chunks ARRAY<STRUCT<chunk_id:STRING,text_idxs:ARRAY<INT>,context_idxs:ARRAY<INT>,start_candidate_idx:INT,end_candidate_idx:INT,"
    "passage_types:ARRAY<STRING>,parent_candidate_idx:INT,chunk_kind:STRING,token_count:INT,context_token_count:INT>>"
)
RECORD = f"passage_id STRING, passage_type STRING, {CHUNK}, {GROUPED}"


def lines(spark: SparkSession, path: str, ordinal: str = "row_ordinal") -> DataFrame:
    """Lines that aren't blank, numbered from 0 in the order of file name and place in the file.

    Each split numbers its own lines; only the splits' counts are summed along the order.
    """
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m")).where(F.trim("value") != "")
    own = raw.withColumn("_n", F.row_number().over(W.partitionBy("_f", "_s").orderBy("_m")))
    sizes = raw.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(W.orderBy("_f", "_s")) - F.col("_c"))  # one row for each split
    return own.join(before.select("_f", "_s", "_before"), ["_f", "_s"]).select((F.col("_before") + F.col("_n") - 1).alias(ordinal), "value")


def read(spark: SparkSession, path: str, schema: str, ordinal: str = "row_ordinal") -> DataFrame:
    """Objects of a JSON Lines file; a line that is no object fails the query."""
    parsed = lines(spark, path, ordinal).withColumn("_j", F.from_json("value", schema, {"mode": "FAILFAST"}))
    checked = parsed.withColumn("_j", F.when(F.trim("value").startswith("{"), F.col("_j")).otherwise(F.raise_error(F.lit("a line must hold a JSON object"))))
    return checked.select(ordinal, "_j.*")


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, RAW)


def passages(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, PASSAGE, "line_no")


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Groups, chunks and passages mixed, with the union of their columns, for ``operators.ingest.index_records``."""
    return read(spark, path, RECORD, "line_no")


def write(df: DataFrame, path: str) -> None:
    """One object a line, nulls left out; written whole or not at all by the commit protocol."""
    df.write.mode("overwrite").json(path)
