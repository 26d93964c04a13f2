"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from knnspark import queries as engine

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return made


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query(spark, db, name):
    got, want = engine.QUERIES[name](spark, str(DATA)).toPandas(), db.sql(engine.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert got.astype(str).equals(want.astype(str))


def test_entry(spark):
    assert entry.entry(spark).count() == 250
    assert set(entry.oracle_sql()) <= set(entry.queries())
