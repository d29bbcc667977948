"""Every training-data query that has SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import pytest
import sqlcheck

from siftline.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return sqlcheck.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    sqlcheck.same(spark, sf, queries.QUERIES[name], queries.ORACLES[name], con)
