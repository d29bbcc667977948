from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


ROW = "row_ordinal bigint, id string, question string, title string, candidates array<string>, passage_types array<string>, long_answers array<string>, document_url string"


@pytest.fixture(scope="session")
def raw(spark):
    def make(*rows, extra=False):
        full = [(i, r.get("id", f"r{i}"), r.get("question"), r.get("title"), r.get("candidates"), r.get("passage_types"), r.get("long_answers"), r.get("document_url")) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, ROW)

    return make
