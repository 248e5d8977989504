"""Queries that SQL can express, against that SQL."""

from __future__ import annotations

import duckdb
import pytest

from tidegauge.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, data, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = duck.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, data).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)

    def rows(t):
        return sorted(zip(*(t.column(n).to_pylist() for n in names)), key=repr)

    assert rows(got) == rows(want) and got.num_rows > 0
    assert [str(got.schema.field(n).type) for n in names] == [str(want.schema.field(n).type).replace("large_", "") for n in names]
