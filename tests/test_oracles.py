"""Every query that has SQL gives what the SQL gives."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from inkfathom.registry import COVERS, ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert sorted(want.column_names) == columns
    ours, theirs = (sorted((tuple(plain(r[c]) for c in columns) for r in t.to_pylist()), key=repr) for t in (got, want))
    assert ours == theirs


def test_registry():
    assert entry.ENTRY in QUERIES and all(COVERS[n] for n in QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "fused"]
