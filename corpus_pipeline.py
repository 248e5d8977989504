"""From raw documents to encoded training text, in stages that each read what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import benchmark_hits, byte_bpe, catalog, factorisation, simhash, toxicity
from tidegauge.llm.frames import skipped
from tidegauge.session import written

#: Near copies: exact Jaccard similarity of sets of so many words' shingles.
ALIKE = 0.8
WORDS = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from labelled rows outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return factorisation.keep_good(docs, factorisation.train(docs, labels, ~skipped(5, 0)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier marks go; it learns from labelled rows outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels, ~skipped(3, 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group stays whose sets of five-word shingles are alike by 0.8 or more."""
    return simhash.keep_one_similar(docs, ALIKE, WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return benchmark_hits.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(catalog.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: The stages use trained models and hashes that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
