"""Every query with SQL against DuckDB over the smallest tables."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    result = duck.execute(SQL[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    a = Counter(tuple(plain(r[c]) for c in sorted(cols)) for r in got)
    b = Counter(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in result.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
