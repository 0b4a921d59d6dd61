import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sigspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(cell(r[p]) for p in places) for r in want.fetchall())


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and QUERIES.keys() <= queries.keys()
    assert entry.entry(spark).count() == 20
