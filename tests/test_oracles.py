"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from scholarlink.jobs.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


def rows(df):
    c = sorted(df.columns)
    return sorted(map(tuple, df[c].astype(object).where(df[c].notna(), None).astype(str).to_numpy()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
