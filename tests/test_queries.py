"""Every query with SQL against DuckDB on the smallest tables; the others run and have a stable schema."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from loomledger import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [p.stem for p in sorted(Path(SF).glob("*.parquet"))]
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "as_tuple") or isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(f"{float(value):.9g}")
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    assert frame.columns and len(frame.collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
