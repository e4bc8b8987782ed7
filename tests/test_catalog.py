"""Every query of the catalog against its SQL on the smallest test data."""

import math
import os

import pytest

from weft.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return v


def key(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    res = duck.sql(catalog.SQL[name])
    assert sorted(res.columns) == names
    at = [res.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=key)
