from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 60_000


@pytest.fixture
def messy(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names operators use themselves."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven", "en", "x"),
        (1, "One two three four five six seven eight nine ten eleven", "en", "x"),
        (2, "one TWO three four five six seven eight nine ten eleven", None, None),
        (3, None, "en", "x"), (4, "", "en", "x"), (5, " \t\n ", None, "x"), (None, "no id here at all", "en", "x"),
        (None, None, None, None), (6, LONG, "en", "x"), (7, "Ünïcode 日本語   text", "de", "x"), (8, "a b", "en", "x"),
        (9, "a b", "en", "x"), (10, "idiot idiot you idiot!!", "en", "x"),
    ]
    clash = ["print", "root", "score", "hits", "shard", "slot", "size", "ids", "n_tokens", "content", "y", "Text_In"]
    schema = "doc_id long, text string, lang string, source string" + "".join(f", `{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *clash) for r in rows], schema)


@pytest.fixture
def no_docs(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
