"""The registered queries with SQL against DuckDB, on the smallest tables and on awkward ones."""

import os
from pathlib import Path

import duckdb
import pytest

from knnspark.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def compare(spark, name, folder):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), db.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: None if x is None or x != x else x if isinstance(x, str) else round(float(x), 9)
    rows = [sorted(str([plain(x) for x in r]) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    compare(spark, name, DATA)


def test_line_dedup_counts_rows(spark, tmp_path):
    """Ten rows of one id share a line; rows without an id count as well."""
    rows = [(1, f"shared\nown {k}") for k in range(10)] + [(k, "nine\nx") for k in range(2, 11)] + [(None, "Nine \nend"), (None, None), (20, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op8_line_dedup", tmp_path)
