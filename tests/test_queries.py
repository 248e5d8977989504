"""Every registered query against its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidegauge.catalog.oracles import ORACLES
from tidegauge.catalog.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def as_rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=repr)
    return names, [str(table.schema.field(n).type).replace("large_", "") for n in names], rows


def clean(table) -> bool:
    return not any(
        isinstance(v, float) and not math.isfinite(v) for n in table.column_names for v in table.column(n).to_pylist()
    )


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert clean(got)
    got_names, got_types, got_rows = as_rows(got)
    want_names, want_types, want_rows = as_rows(want)
    assert got_names == want_names
    assert got_types == want_types
    assert len(got_rows) == len(want_rows)
    assert got_rows == want_rows


def test_shared_parameters_agree():
    from tidegauge.catalog import oracles, queries

    for name in ("HISTORY", "BUDGET", "QOS_MS", "PATH_P", "LOOP_P", "PEEK", "RAW", "CURVE_MORE", "LONGEST"):
        assert getattr(oracles, name) == getattr(queries, name), name


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
