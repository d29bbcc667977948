"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def connect(d):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{d}/{f}')")
    return con


def same(spark, d, query, sql, con):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
