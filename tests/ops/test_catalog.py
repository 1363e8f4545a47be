"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from locspark.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted(want.select(*cols).fetchall(), key=key)
    assert len(a) == len(b) and all(alike(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_entry(spark):
    assert entry.entry(spark).count() == 1  # a movie for every 2,400 events
    assert set(entry.oracle_sql()) <= set(entry.queries())
