"""The registered SQL of the operators against their queries."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from evalmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, data_dir, name):
    con = duckdb.connect()
    for path in Path(data_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.queries()[name](spark, data_dir)
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted.fetchall())
