"""Every registered query of the reference's own operators against its SQL on DuckDB."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from evalmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def cell(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(cell, value))
    return None if value is None else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def tables(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(data_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, data_dir, tables, name):
    found = QUERIES[name](spark, data_dir)
    wanted = tables.execute(SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()
