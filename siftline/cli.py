"""``python -m siftline.cli COMMAND``: thin commands over Parquet folders.

passages IN OUT | chunks IN OUT | index IN OUT | retrieve DATA QUESTION... | evaluate DATA OUT | study DATA | audit DATA | copy IN OUT | doctor
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib.util
import json
import sys

from siftline.config import CONTRACTS, MODES, from_environment


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("siftline").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__)
    p.add_argument("command", choices=("passages", "chunks", "index", "retrieve", "evaluate", "study", "audit", "copy", "doctor"))
    p.add_argument("args", nargs="*")
    p.add_argument("--force", action="store_true")
    p.add_argument("--mode", choices=MODES, default="sparse")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--k", default="1,5,10,20", help="cutoffs, separated by commas")
    p.add_argument("--contract", choices=CONTRACTS, default="answer_overlap")
    a = p.parse_args(argv)
    config = from_environment()
    if a.command == "doctor":
        found = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "regex", "ahocorasick", "xxhash")}
        print(json.dumps({"modules": found, "config": dataclasses.asdict(config)}, indent=1))
        return int(not all(found.values()))
    from pyspark.sql import functions as F

    from siftline.operators import audit, chunking, evaluate, ingest, sparse, strategies
    from siftline.sources import sinks, tables

    spark, settings = _session(), dataclasses.asdict(config)
    if a.command in ("passages", "chunks", "index"):
        source = spark.read.parquet(a.args[0])
        if a.command == "passages":
            made = ingest.first_passages(ingest.explode_passages(ingest.first_rows(source, config.max_raw_rows), config), config.max_passages)
        elif a.command == "chunks":
            made = chunking.chunk(ingest.first_rows(source, config.max_chunk_rows), config).drop("span", "part")
        else:
            made = sparse.index(ingest.first_rows(source, config.max_index_rows, "source_row_ordinal").select("chunk_id", "text"), config, key="chunk_id")
        print(json.dumps(sinks.write_table(made, a.args[1], settings | {"command": a.command, "source": a.args[0]}, a.force)))
    elif a.command == "copy":
        print(json.dumps(sinks.copy_points(spark, a.args[0], a.args[1], recreate=a.force)))
    else:
        rows = tables.table(spark, a.args[0], "nq_sample_rows")
        if a.command == "study":
            study = strategies.study_rows(rows)
            print(sinks.markdown(strategies.strategy_profile(strategies.build_all(study), study), "Strategies"))
        elif a.command == "audit":
            print(sinks.markdown(audit.continuity_summary(rows), "Continuity"))
        else:
            from siftline.engine import Engine

            engine = Engine(spark, tables.table(spark, a.args[0], "index_chunks"), tables.table(spark, a.args[0], "dense_points"), config=config)
            if a.command == "retrieve":
                asked = spark.createDataFrame(list(enumerate(a.args[1:])), "query_id bigint, text string")
                for r in engine.retrieve(asked, a.mode, a.top_k).orderBy("query_id", "final_rank").toLocalIterator():
                    print(json.dumps(r.asDict(recursive=True), default=str))
            else:
                asked = evaluate.gold(engine.chunks).select(F.col("query").alias("text")).distinct()
                asked = asked.select(F.xxhash64("text").alias("query_id"), "text")
                sinks.write_report(spark, engine.evaluate(asked, [a.mode], [int(x) for x in a.k.split(",")], a.contract), a.args[1])
    return 0


if __name__ == "__main__":
    sys.exit(main())
