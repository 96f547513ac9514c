"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from attestor.plans import REGISTRIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: (f, r.oracle.get(n)) for r in REGISTRIES for n, f in r.queries.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v.replace(tzinfo=None)) if hasattr(v, "year") and hasattr(v, "hour") else v


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    f, sql = QUERIES[name]
    df = f(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=repr)
