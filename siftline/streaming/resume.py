"""Resumable writes: a batch that skips what is there, and a stream that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans.shared import cut


def missing(records: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Records whose key isn't among those done."""
    return records.join(done.select(done.columns[0] if done_key is None else done_key).withColumnRenamed(done_key or done.columns[0], key).distinct(), key, "left_anti")


def upsert_missing(records: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Make and append the rows that a table lacks; how many were missing. A second call after a failure does only the rest."""
    spark = records.sparkSession
    try:
        rest = missing(records, spark.read.parquet(path).select(key), key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rest = records
    rest = cut(rest.dropDuplicates([key]))  # made once; a key that a batch repeats is one
    n = rest.count()
    if n:
        make(rest).write.mode("append").parquet(path)
    return n


def stream_upsert(spark: SparkSession, source: str, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], key: str, files_per_batch: int = 64) -> int:
    """Take new files of a folder through ``make`` into a table, as far as there are any; batches done.

    The checkpoint remembers which files are done; inside a batch, keys that a failed try wrote already are left out.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done = []

    def batch(df: DataFrame, number: int) -> None:
        upsert_missing(df, target, key, make)
        done.append(number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
