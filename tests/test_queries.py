"""Every registered query against DuckDB on the smallest tables; those without SQL run twice and must agree."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{DIR}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    mine = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        again = registry.queries()[name](spark, DIR)
        assert rows(again.columns, again.collect()) == mine
        return
    theirs = duck.sql(sql)
    assert sorted(theirs.columns) == sorted(df.columns)
    assert rows(theirs.columns, theirs.fetchall()) == mine


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
