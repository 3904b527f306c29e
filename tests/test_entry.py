import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievekit import queries

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def test_names():
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@here
def test_entry(spark):
    assert entry.entry(spark).columns == ["digest", "n_rows", "n_files", "first_scan", "last_scan"]


@here
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_against_sql(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    cols = sorted(rows.columns)
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in rows.collect())))
    if name not in queries.SQL:
        assert got
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    out = con.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())
