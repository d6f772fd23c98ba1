"""Every query with a SQL twin equals it on the smallest tables, which DuckDB reads side by side."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from panelforge import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, FOLDER)
    found = db.execute(plans.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
