"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import (
    archives, benchmark_hits, byte_bpe, collision_search, factorisation, jump_shards, language_mixture, mean_order,
    ngram_trie, pivot_codes, simhash, token_counts, toxicity, twins,
)
from tidegauge.llm.frames import skipped

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), skipped(3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), skipped(5, 1)
    return ngram_trie.score(docs, ngram_trie.train(docs, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.neighbours(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), skipped(5, 0)
    model = factorisation.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return factorisation.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), token_counts.fresh_cache(spark)
    )


def op11_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), skipped(5, 0)
    return language_mixture.identify(docs, language_mixture.train(docs, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "shares"
    )


def op12_mean_order_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_order.cluster(table(spark, sf_dir, "embeddings"))


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_warc_revisits, op3_toxicity, op4_ngram_trie, op5_jump_shards, op6_byte_bpe,
        op7_benchmark_hits, op8_collision_search, op9_quality, op10_token_counts, op11_language_mixture, op12_mean_order_clusters,
        op13_pivot_codes,
    )
}

ORACLES: dict[str, str] = {
    "op2_warc_revisits": twins.WARC_REVISITS, "op7_benchmark_hits": twins.BENCHMARK_HITS,
    "op12_mean_order_clusters": twins.MEAN_ORDER_CLUSTERS, "op13_pivot_codes": twins.PIVOT_CODES,
}
