"""All registered queries of the replica operators run at sf0.001, and equal their SQL where they have one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from replicalens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.SQL:
        want = duck.sql(Q.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        names = sorted(got.columns)
        plain = lambda t: sorted(t[names].astype(object).where(t[names].notna(), None).astype(str).itertuples(index=False, name=None))
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
