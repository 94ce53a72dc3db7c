"""Registered queries against their SQL in DuckDB, and the contract's shape."""

import collections
import datetime
import decimal
import math

import duckdb
import pytest

from tabularium.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Large enough for every query with SQL to have rows.
SQL_SF = "/root/testdata/sf0.01"
#: Queries that rightly find nothing in these tables; each has a twin on planted rows.
EMPTY = {"anomalies"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SQL_SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    return float(v) if isinstance(v, decimal.Decimal) else v


def bag(rows):
    return collections.Counter(tuple(str(plain(r[k])) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SQL_SF)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = df.collect()
    assert rows or name in EMPTY
    assert bag(r.asDict() for r in rows) == bag(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    registry.queries()[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
