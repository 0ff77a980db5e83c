"""Every relational query against its DuckDB oracle, and the entry point."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from grainmill.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr([row[c] for c in names]) for row in df.collect())
    if sql := registry.oracle_sql().get(name):
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        expected = sorted(repr([row[columns.index(c)] for c in names]) for row in result.fetchall())
        assert sorted(columns) == names
        assert got == expected
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
