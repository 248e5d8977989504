"""Token counts through a cache of content digests.

A text's count depends on its content and on the tokenizer's file. Both are
digested, the digests are joined to the stored counts, only contents that have
none are encoded, once each, and what they give is appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.frames import map_column
from tidegauge.session import fresh_path, written

CACHE = "content binary, tokenizer string, n_tokens long"
LIMIT = 4096


def content_digest(text: str = "text"):
    """SHA-256 of the content as the tokenizer sees it: UTF-8, null as empty.

    Nothing else may be folded: this kind of tokenizer keeps case and spaces.
    """
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent or still empty folder holds none."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


_held: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _processor(model: bytes, version: str) -> sentencepiece.SentencePieceProcessor:
    if version not in _held:
        _held.clear()
        _held[version] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _held[version]


def count_distinct(misses: DataFrame, model_path: str, version: str) -> DataFrame:
    """``(content, n_tokens)``, once for every content of ``misses(content, text)``.

    Copies are dropped in the task that reads them, so of a content that very
    many rows share one row per task crosses the network; all rows of a content
    then meet in one task, which encodes the first.
    """
    with open(model_path, "rb") as file:
        model = misses.sparkSession.sparkContext.broadcast(file.read())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for digest in batch.column(0).to_pylist():
                new.append(digest not in seen)
                seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))

    def count(texts: pa.Array) -> list[pa.Array]:
        processor = _processor(model.value, version)
        return [pa.array([len(processor.encode(t.as_py() or "")) for t in texts], pa.int64())]

    once = misses.select("content", "text").mapInArrow(first, "content binary, text string")
    parts = int(misses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = once.repartition(parts, "content").mapInArrow(first, "content binary, text string")
    return map_column(met, "text", "n_tokens long", count)


def token_counts(
    docs: DataFrame, model_path: str, cache_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    A null text counts as empty and has no tokens. Null and repeated ids keep
    their rows; other columns play no part. The cache is a Parquet folder that
    all executors reach; one that does not exist is begun. New counts are
    appended in one committed write. Should two runs append the same content,
    the counts are equal and either is used.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        version = sha256(file.read()).hexdigest()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("content", content_digest())
    narrow = written(
        rows.select("doc_id", "content", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")),
        "digests",
    )
    known = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    misses = rows if known.isEmpty() else rows.join(known, "content", "left_anti")
    count_distinct(misses, model_path, version).select(
        "content", F.lit(version).alias("tokenizer"), "n_tokens"
    ).write.mode("append").parquet(cache_path)
    counts = (
        open_cache(spark, cache_path).filter(F.col("tokenizer") == version)
        .groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return narrow.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def fresh_cache(spark: SparkSession) -> str:
    return fresh_path(spark, "token-counts")
