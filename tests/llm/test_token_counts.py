from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.errors import AnalysisException

from tidegauge.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(rows, docs, limit=4096):
    want = []
    for d in docs.collect():
        text = d["text"] or ""
        n = len(LIBRARY.encode(text))
        want.append((d["doc_id"], len(text.encode()), n, n > limit))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_messy_rows(messy, no_docs, tmp_path):
    check(token_counts.token_counts(messy, PATH, str(tmp_path / "cache")).collect(), messy)
    assert token_counts.token_counts(no_docs, PATH, str(tmp_path / "none")).count() == 0


def test_query_equals_library(documents, tmp_path):
    check(token_counts.token_counts(documents, PATH, str(tmp_path / "cache")).collect(), documents)


def test_only_what_the_cache_lacks_is_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "doc_id long, text string")
    check(token_counts.token_counts(first, PATH, cache).collect(), first)
    assert spark.read.parquet(cache).count() == 2
    # a wrong stored count shows that it is used instead of a new one
    spark.createDataFrame(
        [(r["content"], r["tokenizer"], 77) for r in spark.read.parquet(cache).collect()], token_counts.CACHE
    ).write.mode("overwrite").parquet(f"{cache}-marked")
    more = first.union(spark.createDataFrame([(4, "delta"), (5, None), (6, "")], first.schema))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(more, PATH, f"{cache}-marked").collect()}
    assert got == {1: 77, 2: 77, 3: 77, 4: len(LIBRARY.encode("delta")), 5: 0, 6: 0}
    assert spark.read.parquet(f"{cache}-marked").count() == 4


def test_counts_of_another_tokenizer_are_not_used(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    content = docs.select(token_counts.content_digest().alias("content")).first()["content"]
    spark.createDataFrame([(content, "other", 99)], token_counts.CACHE).write.parquet(cache)
    check(token_counts.token_counts(docs, PATH, cache).collect(), docs)


def test_only_an_absent_cache_counts_as_empty(spark, tmp_path, monkeypatch):
    assert token_counts.open_cache(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "begun").mkdir()
    assert token_counts.open_cache(spark, str(tmp_path / "begun")).count() == 0
    monkeypatch.setattr(token_counts, "CACHE", "content binary, content string")
    with pytest.raises(AnalysisException):
        token_counts.open_cache(spark, str(tmp_path / "begun"))
