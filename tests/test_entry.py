"""The driver's contract: the core queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lateview import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE_SQL) and set(core.QUERIES) <= set(entry.queries())


def test_what_is_not_there_is_told_from_what_fails():
    assert entry._there("lateview.queries") and not entry._there("lateview.nothing") and not entry._there("lateview.nothing.more") and not entry._there("no_such_pipeline")


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
