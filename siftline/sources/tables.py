"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.plans.shared import ship

TABLES = ("nq_sample_rows", "index_chunks", "index_chunk_groups", "pass1_states", "dense_points", "documents", "source_targets", "embeddings")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters of later steps reach the Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
