"""Each core query over the smallest tables against its SQL in DuckDB; those without SQL give rows with stated columns."""

import glob
import os

import pytest

from foliospark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([None if r[i] is None else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connection, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if sql := catalog.oracle_sql().get(name):
        got = connection.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(got.fetchall(), names) == plain(rows, df.columns)


def test_the_oracles_have_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
