"""Every registered query against its SQL on the smallest tables, and the plan of the similarity join."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barweave import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "float" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: "NULL" if v != v else f"{v + 0.0:.5f}")
        else:  # DuckDB's dates come as timestamps at midnight
            df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA else str(v).removesuffix(" 00:00:00"))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    a, b = norm(entry.queries()[name](spark, SF).toPandas()), norm(con.sql(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["symbol", "q_day", "rank", "h_day", "similarity", "corr"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similarity_join_has_no_cartesian_product(spark):
    plan = entry.queries()["ma8_composite_similarity"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
