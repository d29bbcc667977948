"""A sparse index as stored tables: postings, idf and counts with a manifest, and document weights that are written resumably.

The manifest is written last and holds the settings that decide the tables and a fingerprint of the documents, so an index of other
settings or of changed documents is never read for the one asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.operators import sparse
from siftline.sources import sinks
from siftline.streaming.resume import upsert_missing

TABLES = ("posted", "idf", "stats")
DECISIVE = ("analyzer", "bm25_k1", "bm25_b", "bm25_epsilon")


def settings_of(config: EngineConfig) -> dict:
    return {name: getattr(config, name) for name in DECISIVE}


def fingerprint(docs: DataFrame, key: str = "doc_id") -> dict:
    """How many documents there are and a sum over hashes of each, which no order changes."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(F.col(key).cast("string"), "text").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return {"documents": r.n, "hash": r.h}


def save(index: sparse.Index, path: str, config: EngineConfig, source: dict) -> dict:
    """Write the tables, then the manifest with the counts; the manifest."""
    spark = index.posted.sparkSession
    fs, old = sinks._file(spark, f"{path}.manifest.json")
    fs.delete(old, False)  # from here on there is no index until all of it is there
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    s = spark.read.parquet(f"{path}/stats").first()
    made = sinks.manifest(settings_of(config), s.document_count, source=source, total_tokens=s.total_tokens, terms=spark.read.parquet(f"{path}/idf").count())
    sinks.write_json(spark, f"{path}.manifest.json", made)
    return made


def load(spark: SparkSession, path: str, config: EngineConfig, source: dict | None = None) -> sparse.Index:
    """The stored index; an error tells what is missing or was made otherwise."""
    m = sinks.read_json(spark, f"{path}.manifest.json")
    if not isinstance(m, dict) or m.get("version") != sinks.VERSION:
        raise ValueError(f"no whole index at {path}")
    wrong = [k for k, v in settings_of(config).items() if m["settings"].get(k) != v]
    if wrong:
        raise ValueError(f"the index at {path} was made with other settings: {', '.join(wrong)}")
    if source is not None and m.get("source") != source:
        raise ValueError(f"the index at {path} was made of other documents")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    for name, columns in (("posted", {"doc_id", "term", "len", "tf"}), ("idf", {"term", "df", "idf"}), ("stats", {"document_count", "total_tokens", "avg_doc_len"})):
        if not columns <= set(tables[name].columns):
            raise ValueError(f"the index at {path} lacks columns of {name}: {', '.join(sorted(columns - set(tables[name].columns)))}")
    return sparse.Index(**tables)


def build(docs: DataFrame, path: str, config: EngineConfig = EngineConfig(), key: str = "doc_id", recreate: bool = False) -> tuple[sparse.Index, int]:
    """The index of the documents at a path, made if it isn't there, and how many documents' weights were written.

    ``weights`` beside it takes one row for each document with its terms and weights; a run that was broken off goes on with the
    documents it lacks. An index of other settings or documents is an error unless it is to be recreated.
    """
    spark, source = docs.sparkSession, fingerprint(docs, key)
    fs, folder = sinks._file(spark, path)
    have = sinks.read_json(spark, f"{path}.manifest.json")
    if have is None or recreate:
        fs.delete(folder, True)
        save(sparse.build(docs, config, key=key), path, config, source)
    index = load(spark, path, config, source)

    def weigh(rest: DataFrame) -> DataFrame:
        mine = index.posted.join(rest.select("doc_id"), "doc_id", "left_semi")
        entry = F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms")
        held = sparse.weights(mine, index.idf, index.stats, config).groupBy("doc_id").agg(entry)
        return rest.select("doc_id").join(held, "doc_id", "left")  # documents without tokens are done too

    return index, upsert_missing(docs.select(F.col(key).alias("doc_id")), f"{path}/weights", "doc_id", weigh)
