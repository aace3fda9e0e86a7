"""Queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = entry.core


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')").fetchall()
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_same_rows(spark, con, name):
    df = CORE.QUERIES[name](spark, str(DATA))
    result = con.execute(CORE.SQL[name])
    columns = [d[0] for d in result.description]
    theirs = [dict(zip(columns, row)) for row in result.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    rows = lambda found: sorted(tuple(normal(r[c]) for c in sorted(columns)) for r in found)
    assert rows(df.collect()) == rows(theirs)


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
