"""Every query with SQL against DuckDB on the same files."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from stratafold.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if not isinstance(v, str) else v
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DIR).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
