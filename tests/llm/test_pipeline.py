from __future__ import annotations

import public_tokenizers
from test_simhash import literal_similar

import __spark_entry__ as entry
import corpus_pipeline
from tidegauge.llm import benchmark_hits, byte_bpe, simhash
from tidegauge.llm.catalog import ORACLES, QUERIES


def test_queries_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run and set(ORACLES) <= set(QUERIES)


def test_stages(spark, data, documents, labels):
    assert len(corpus_pipeline.STAGES) == 5
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, data)
        if stage is not corpus_pipeline.encode:
            assert made.schema == documents.schema
            made = corpus_pipeline.written(made, "stage")
            seen[name] = (docs, made)
            docs = made
    before, after = seen["simhash near-dedup"]
    kept = {r["doc_id"] for r in after.collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    ids = sorted(texts)
    assert kept == {ids[root] for root in literal_similar([texts[i] for i in ids], corpus_pipeline.ALIKE, corpus_pipeline.WORDS)}
    before, after = seen["benchmark decontamination"]
    hits = benchmark_hits.contamination(before, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert {r["doc_id"] for r in hits.filter("not contaminated").collect()} == {r["doc_id"] for r in after.collect()}
    got = sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))
    want = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got == sorted(map(tuple, want.collect()))
    # clean rows stay, marked ones go
    marks = {r["doc_id"]: r for r in labels.collect()}
    for name, column, bad in (("quality classifier", "quality", 0), ("toxicity", "toxic", 1)):
        before, after = seen[name]
        left = {r["doc_id"] for r in after.collect()}
        asked = [r["doc_id"] for r in before.collect() if r["doc_id"] in marks]
        clean = [i for i in asked if marks[i][column] != bad]
        assert sum(i in left for i in clean) >= 0.95 * len(clean)


def test_near_copies_at_eight_tenths_go(spark, data, documents):
    """Documents 1 and 177 share 0.83 of their five-word shingles and differ in nine bits of SimHash."""
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents, data).collect()}
    groups = {r["component_id"] for r in simhash.near_duplicates(documents).collect()}
    assert 1 in kept and 177 not in kept and kept == groups - {177}
