"""Every core query that has SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import pytest
import sqlcheck

from siftline.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return sqlcheck.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    sqlcheck.same(spark, sf, registry.QUERIES[name], registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
