"""Every query that has SQL gives the rows of that SQL; every other query runs."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from spangrid.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5) if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(columns).collect()]
    if name not in ORACLES:
        assert columns
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=order) == sorted(want, key=order)
