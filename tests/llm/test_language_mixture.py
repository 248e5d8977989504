"""Grams and mixtures against plain dictionaries, held-out languages, and messy rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import language_mixture as lm
from tidegauge.llm.frames import skipped


def literal_grams(text):
    data = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in b" " + text.lower().encode() + b" ")
    out = Counter()
    for i in range(1, len(data) - 1):
        if data[i] != 0x20:
            code = data[i - 1] << 16 | data[i] << 8 | data[i + 1]
            out[(code * 2654435769 % 2**32) >> 16] += 1
    return out


def literal_shares(grams, chance, rounds=2000):
    """Plain expectation-maximisation, far beyond where it settles."""
    n, k = sum(grams.values()), chance.shape[1]
    share = [1 / k] * k
    for _ in range(rounds):
        after = [0.0] * k
        for b, c in grams.items():
            mixed = sum(s * p for s, p in zip(share, chance[b]))
            for i in range(k):
                after[i] += c / n * share[i] * chance[b][i] / mixed
        share = after
    return share


def counted(texts):
    out = [Counter() for _ in texts]
    for at, g in lm.stretches(pa.array(texts, pa.string())):
        for r, b, c in zip(g.row, g.bucket, g.count):
            out[at + r][int(b)] += int(c)
    return out


def test_grams_match_a_dictionary(monkeypatch):
    texts = ["One two.", None, "", "ÀÉ über1straße", "a", "日本語 text", "  \n", "word " * 40, "x" * 100]
    want = [literal_grams(t or "") for t in texts]
    assert counted(texts) == want
    monkeypatch.setattr(lm, "STRETCH", 16)
    assert counted(texts) == want


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return lm.train(docs, F.lit(True))


def test_training_counts_are_the_whole_table(spark, data, model):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()
    assert model.names == sorted({r["lang"] for r in rows})
    totals = {name: Counter() for name in model.names}
    for r in rows:
        totals[r["lang"]] += literal_grams(r["text"])
    for i, name in enumerate(model.names):
        n = sum(totals[name].values()) + lm.SMOOTH * lm.BUCKETS
        for b, c in totals[name].most_common(200):
            assert model.chance[b, i] == pytest.approx((c + lm.SMOOTH) / n)
    assert np.allclose(model.chance.sum(0), 1)


def test_shares_and_likelihood_match_plain_iteration(model):
    texts = ["the house and the other thing entered", "der nicht und die schon heit", "the thing und der nicht die schei"]
    for text in texts:
        grams = literal_grams(text)
        _, g = next(lm.stretches(pa.array([text])))
        share, likelihood = model.fit(g, np.ones((1, len(model.names)), bool))
        want = literal_shares(grams, model.chance)
        assert share[0] == pytest.approx(want, abs=0.02) and share.sum() == pytest.approx(1)
        best = sum(c * math.log(sum(s * p for s, p in zip(want, model.chance[b]))) for b, c in grams.items())
        assert likelihood[0] == pytest.approx(best, abs=0.05)


def test_selection_pays_for_each_language(model):
    """A language goes exactly if the likelihood lost without it is below its price."""
    text = "the house and the other thing, der nicht und die schon heit " * 4
    _, g = next(lm.stretches(pa.array([text])))
    share = model.select(g)[0]
    kept = share > 0
    price = lm.PRICE * 0.5 * math.log(g.count.sum())
    full = model.fit(g, kept[None])[1][0]
    for i in np.flatnonzero(kept):
        fewer = kept.copy()
        fewer[i] = False
        if fewer.any() and share[i] == share[kept].min():
            assert full - model.fit(g, fewer[None])[1][0] >= price


def test_two_languages_are_both_found(spark, data, model):
    rows = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) > 2000").select("text", "lang").collect()
    one = {r["lang"]: r["text"] for r in rows}
    half, third = one["en"][:1500] + "\n" + one["fr"][:1500], one["de"][:2000] + "\n" + one["es"][:1000]
    got = {r["doc_id"]: r for r in lm.identify(spark.createDataFrame([(1, half), (2, third), (3, one["en"])], "doc_id long, text string"), model).collect()}
    assert set(got[1]["shares"]) == {"en", "fr"} and min(got[1]["shares"].values()) > 0.4
    assert set(got[2]["shares"]) == {"de", "es"} and got[2]["lang_pred"] == "de" and 0.6 < got[2]["score"] < 0.75
    assert got[3]["lang_pred"] == "en" and got[3]["score"] > 0.95


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = skipped(5, 0)
    rows = lm.identify(docs, lm.train(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").filter(held).toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.995 and rows["score"].between(0, 1).all()


def test_messy_rows(spark, messy, no_docs, model):
    got = lm.identify(messy, model).collect()
    assert len(got) == messy.count()
    none = {r["doc_id"] for r in got if r["lang_pred"] == lm.UNDETERMINED}
    assert {3, 4, 5} <= none and 6 not in none and all(r["score"] == 0 and not r["shares"] for r in got if r["lang_pred"] == "und")
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    assert lm.identify(no_docs, model).count() == 0
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "²"), (3, "ж"), (4, "12 a")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in lm.identify(digits, model).orderBy("doc_id").collect()] == [True, True, False, False]


def test_without_any_language(spark, messy, no_docs):
    for empty in (no_docs, messy.withColumn("lang", F.lit(None).cast("string"))):
        model = lm.train(empty, F.lit(True))
        assert model.names == [] and {r["lang_pred"] for r in lm.identify(messy, model).collect()} == {"und"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([("a b", "x"), ("c d", "y"), ("e f", "z")], "text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        lm.train(docs, F.lit(True))
