"""Every query with SQL against DuckDB on the smallest tables; the others against brute force elsewhere."""

import glob
import os

import duckdb
import pytest

from scorewright.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    result = db.execute(catalog.ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    want = sorted(repr([plain(r[found.index(c)]) for c in names]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() == 11
