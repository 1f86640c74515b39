"""The contract's queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from scorewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    found = [c[0] for c in result.description]
    want = sorted(repr([r[found.index(c)] for c in names]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == want
