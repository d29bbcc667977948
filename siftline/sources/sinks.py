"""Tables with a manifest beside them, copies that are verified, and reports.

A table is written by Spark's commit protocol, its manifest after it: a manifest therefore means a whole table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file with sorted keys, on any file system; put in place by a rename."""
    fs, final = _file(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(temporary, final)


def read_json(spark: SparkSession, path: str):
    """The file's value; null if it is missing or no JSON."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def manifest(settings: Mapping, rows: int, **more) -> dict:
    return {"version": VERSION, "settings": dict(settings), "rows": rows, "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **more}


def is_fresh(spark: SparkSession, path: str, settings: Mapping) -> bool:
    """Whether the table at the path was made with these settings and still has the rows its manifest names."""
    m = read_json(spark, f"{path}.manifest.json")
    if not isinstance(m, dict) or m.get("version") != VERSION or m.get("settings") != json.loads(json.dumps(dict(settings))):
        return False
    fs, p = _file(spark, path)
    return bool(fs.exists(p)) and spark.read.parquet(path).count() == m.get("rows")


def write_table(df: DataFrame, path: str, settings: Mapping, force: bool = False) -> dict:
    """Write a table and its manifest unless it is fresh; the manifest."""
    spark = df.sparkSession
    if not force and is_fresh(spark, path, settings):
        return read_json(spark, f"{path}.manifest.json")
    fs, m = _file(spark, f"{path}.manifest.json")
    fs.delete(m, False)
    df.write.mode("overwrite").parquet(path)
    made = manifest(settings, spark.read.parquet(path).count())
    write_json(spark, f"{path}.manifest.json", made)
    return made


def copy_points(spark: SparkSession, source: str, target: str, recreate: bool = False, dry_run: bool = False) -> dict:
    """Copy a table of points and verify that source, target and copied rows are as many."""
    points = spark.read.parquet(source)
    if "dense" not in points.columns:
        raise RuntimeError("the source has no dense vectors")
    n = points.count()
    fs, p = _file(spark, target)
    there = bool(fs.exists(p))
    if there and not recreate:
        raise RuntimeError(f"{target} exists")
    if not dry_run:
        points.write.mode("overwrite" if recreate else "errorifexists").parquet(target)
        if (got := spark.read.parquet(target).count()) != n:
            raise RuntimeError(f"{got} of {n} points were copied")
    return {"source_count": n, "copied": 0 if dry_run else n, "dry_run": dry_run}


def assert_sparse_ready(points: DataFrame) -> None:
    """Postings need terms and weights."""
    if missing := {"doc_id", "term", "weight"} - set(points.columns):
        raise RuntimeError(f"no sparse vectors: {sorted(missing)} missing")


def write_report(spark: SparkSession, metrics: DataFrame, path: str) -> dict:
    """The evaluation's means as JSON and as one CSV file; at most one row for each mode and k."""
    rows = [r.asDict() for r in metrics.orderBy("mode", "k").collect()]
    report = {"modes": {}}
    for r in rows:
        report["modes"].setdefault(r["mode"], {"metrics_by_k": {}})["metrics_by_k"][str(r["k"])] = {k: r[k] for k in ("query_count", "recall_at_k", "mrr_at_k", "ndcg_at_k")}
    write_json(spark, f"{path}.json", report)
    metrics.orderBy("mode", "k").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    return report


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()
