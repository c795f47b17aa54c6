"""The training-data queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

queries = pytest.importorskip("larkspur.llm.queries")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
