"""The queries that SQL can express, on the smallest test data."""

import os

import pytest

from weft.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # The smallest data have too few documents for exact shares.
    folder = FOLDER if name != "p8_check" else "/root/testdata/sf0.01"
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = Q.queries()[name](spark, folder)
    res = con.sql(Q.SQL[name])
    names = sorted(df.columns)
    at = [res.columns.index(c) for c in names]
    plain = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    assert plain(tuple(r[c] for c in names) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in res.fetchall())
