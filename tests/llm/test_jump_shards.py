from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import jump_shards


def literal(key: int, shards: int) -> int:
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shard_is_that_of_the_published_loop(spark):
    rng = random.Random(4)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 200), *(rng.randrange(-(2**63), 2**63) for _ in range(2000))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 100):
        got = jump_shards.with_shard(rows, "k", shards).collect()
        assert [r["shard"] for r in got] == [literal(r["k"], shards) for r in got], shards


def test_only_builtin_expressions(spark, documents):
    plan = jump_shards.shard_documents(documents, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check(rows, docs, shards=8):
    want = sorted(
        (d["doc_id"] is None, d["doc_id"] or 0, len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode()))
        for d in docs.collect()
    )
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        assert r["law"] == "key" and r["shard"] == literal(r["doc_id"] or 0, shards)
        assert r["grown_shard"] == literal(r["doc_id"] or 0, shards + 1) in (r["shard"], shards)
        slots.setdefault(r["shard"], []).append(r["slot"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_messy_rows(messy, no_docs):
    check(jump_shards.shard_documents(messy, 8).collect(), messy)
    assert jump_shards.shard_documents(no_docs, 8).count() == 0


def test_query_equals_brute_force(documents):
    check(jump_shards.shard_documents(documents, 8).collect(), documents)


def test_one_row_that_is_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(jump_shards, "ROWS_PER_RANGE", 50)
    rows = [(5, "same")] * 400 + [(i, f"text {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(jump_shards.shard_documents(docs, 8).collect(), docs)


def test_other_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, shard int")
    got = jump_shards.with_shard(rows, "k", 8, "place").collect()
    assert all(0 <= r["place"] < 8 for r in got) and [r["shard"] for r in got] == [1, 2, 3]
    with pytest.raises(ValueError):
        jump_shards.jump_shard(F.lit(1), 0)


def test_written_shards(spark, messy, tmp_path):
    jump_shards.write_shards(messy, "doc_id", 4, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == messy.count()
