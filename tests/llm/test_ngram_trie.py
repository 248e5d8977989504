from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import ngram_trie
from tidegauge.llm.frames import skipped


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


class Literal:
    """The same model with dictionaries, and shares quantised one by one."""

    def __init__(self, texts, order):
        self.order, self.grams, self.sums, self.fan = order, Counter(), Counter(), Counter()
        for text in texts:
            words = [b" "] * (order - 1) + tokens(text)
            for i in range(order - 1, len(words)):
                for level in range(1, order + 1):
                    self.grams[tuple(words[i - level + 1 : i + 1])] += 1
        for gram, c in self.grams.items():
            self.sums[gram[:-1]] += c
            self.fan[gram[:-1]] += 1
        self.n = sum(c for g, c in self.grams.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.grams)

    def p(self, gram, quantised):
        if len(gram) == 1:
            return (self.grams[gram] + 0.5) / (self.n + 0.5 * (self.v + 1))
        context = gram[:-1]
        lower = self.p(gram[1:], quantised)
        if not self.sums[context]:
            return lower
        share = (self.grams[gram] - 0.75) / self.sums[context] if gram in self.grams else 0.0
        if share and quantised:
            share = 10 ** (-np.ceil(-np.log10(share) * 32) / 32)
        return share + 0.75 * self.fan[context] / self.sums[context] * lower

    def score(self, text, quantised=True):
        words = [b" "] * (self.order - 1) + tokens(text)
        return sum(np.log10(self.p(tuple(words[i - self.order + 1 : i + 1]), quantised)) for i in range(self.order - 1, len(words)))


@pytest.mark.parametrize(("order", "shard_bytes", "at_once"), [(2, 1 << 20, 2_000_000), (2, 60_000, 5_000), (3, 60_000, 5_000)])
def test_scores_equal_a_model_of_dictionaries(spark, documents, monkeypatch, order, shard_bytes, at_once):
    monkeypatch.setattr(ngram_trie.pieces, "__defaults__", (at_once,))
    held_out = skipped(5, 1)
    rows = documents.collect()
    learn = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for r in rows}
    model = Literal([r["text"] for r in rows if learn[r["doc_id"]]], order)
    trie = ngram_trie.train(documents, ~held_out, order=order, shard_bytes=shard_bytes)
    assert (trie.tokens, trie.words) == (model.n, model.v)
    got = {r["doc_id"]: r for r in ngram_trie.score(documents, trie).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = tokens(r["text"])
        mine = got[r["doc_id"]]
        known = [model.grams[(w,)] for w in words]
        assert (mine["n_tokens"], mine["n_known"], mine["train_tokens"]) == (len(words), sum(c > 0 for c in known), model.n)
        base = sum(np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1))) for c in known)
        assert mine["base_score"] == pytest.approx(base, rel=1e-9)
        if len(trie.present) == 1:
            assert mine["score"] == pytest.approx(model.score(r["text"]), rel=1e-9)
        # shares of a spread context are rounded in each shard, so only the bounds are the same
        exact = model.score(r["text"], quantised=False)
        assert exact - (order - 1) * len(words) / 32 <= mine["score"] <= exact + 1e-9
    better = [g["score"] - g["base_score"] for i, g in got.items() if not learn[i]]
    assert np.mean(better) > 0


def test_probabilities_of_a_context_add_up_to_one_at_most(spark):
    texts = ["a b a c a b", "b c", "", "a"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    model = Literal(texts, 2)
    trie = ngram_trie.train(docs, F.lit(True))
    for context in ("", "a ", "b ", "zz "):
        asked = [f"{context}{w}" for w in ("a", "b", "c", "unseen")] + [context]
        got = {r["doc_id"]: r["score"] for r in ngram_trie.score(
            spark.createDataFrame(enumerate(asked), "doc_id long, text string"), trie).collect()}
        # take the probability of the last token alone from the dictionaries' scores of the rest
        total = 0.0
        for i, text in enumerate(asked):
            assert got[i] == pytest.approx(model.score(text))
            words = [b" ", *tokens(text)]
            total += model.p(tuple(words[len(context.split()) : len(context.split()) + 2]), True)
        assert 0.8 < total <= 1 + 1e-9


def test_messy_rows(messy, no_docs):
    trie = ngram_trie.train(messy, F.lit(True))
    got = ngram_trie.score(messy, trie).collect()
    assert len(got) == messy.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(np.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in got)
    empty = ngram_trie.train(no_docs, F.lit(True))
    assert empty.tokens == 0 and ngram_trie.score(no_docs, empty).count() == 0
    assert {r["n_known"] for r in ngram_trie.score(messy, empty).collect()} == {0}


def test_a_file_is_mapped_as_it_was_written(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint8), "b": np.array([], np.int64), "c": np.array([1.5, 2.5])}
    for uri in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        ngram_trie.save(uri, arrays)
        ngram_trie.save(uri, arrays)
        found = ngram_trie.load(uri)
        assert all((found[k] == v).all() and found[k].dtype == v.dtype for k, v in arrays.items())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]


@pytest.mark.parametrize("order", [2, 3])
def test_a_context_that_is_frequent_only_late_in_the_texts_is_spread(spark, order):
    texts = [" ".join(f"filler{i}x{j}" for j in range(450)) + "".join(f" very late w{i}x{j}" for j in range(100)) for i in range(30)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    trie = ngram_trie.train(docs, F.lit(True), order=order, shard_bytes=20_000)
    late = np.array([ngram_trie.word_hash(b"late")], np.uint64)
    assert trie.shards > 8 and trie.hot[2][int(late[0])] == (3000, 3000)
    if order == 3:
        pair = ngram_trie.mixed(np.array([ngram_trie.word_hash(b"very")], np.uint64), late)
        assert trie.hot[3][int(pair[0])] == (3000, 3000)
    assert all(len(level) <= 8 * trie.shards + 1 for level in trie.hot.values())
