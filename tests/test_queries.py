"""Every query with SQL gives the same rows as DuckDB; the others run."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from lodestrata.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    want = Counter(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_is_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "project_id", "doc_id", "rrf", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
