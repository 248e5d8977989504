"""The two classifiers: held-out quality, messy rows, and the parts they are made of."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import boosting, factorisation, toxicity
from tidegauge.llm.frames import skipped
from tidegauge.llm.labelled import labelled_sample


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    n = int(y.sum())
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def larger(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "fold", "least"), [
    (toxicity, "toxic", (3, 1), 0.93), (factorisation, "quality", (5, 0), 0.98),
])
def test_held_out_rows(larger, module, label, fold, least):
    docs, labels = larger
    fold = skipped(*fold)
    model = module.train(docs, labels, ~fold)
    scored = module.score(docs, model)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter(fold).toPandas()
    assert rows["score"].between(0, 1).all()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    good = rows[rows[label] == (0 if label == "toxic" else 1)]
    kept = good["predicted"] == (0 if label == "toxic" else 1)
    assert kept.mean() > 0.97
    assert (rows["predicted"] == rows[label]).mean() > 0.94


@pytest.mark.parametrize("module", [toxicity, factorisation])
def test_messy_rows(spark, messy, no_docs, module, documents, labels):
    model = module.train(documents, labels, F.lit(True))
    got = module.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert module.score(no_docs, model).count() == 0
    drop = module.drop_toxic if module is toxicity else module.keep_good
    assert drop(messy, model).schema == messy.schema and drop(no_docs, model).count() == 0
    kept = {r["doc_id"] for r in drop(messy, model).collect()}
    assert {r["doc_id"] for r in got if r["predicted"] == (0 if module is toxicity else 1)} == kept


@pytest.mark.parametrize("module", [toxicity, factorisation])
def test_without_any_label(messy, labels, module):
    model = module.train(messy, labels.limit(0), F.lit(True))
    scores = {r["score"] for r in module.score(messy, model).collect()}
    assert all(0 <= s <= 1 for s in scores)


def test_sample_is_bounded_and_has_an_id_once(spark):
    docs = spark.createDataFrame([(i % 500, f"text {i % 500}") for i in range(1500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(7, 0), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.col("doc_id") >= 0, 10**6).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 500
    assert {r["y"] for r in rows if r["doc_id"] == 7} == {0}
    some = labelled_sample(docs, labels, "toxic", F.col("doc_id") >= 0, 100).count()
    assert 60 < some < 140


def test_scores_do_not_depend_on_what_is_not_text(documents, labels):
    model = factorisation.train(documents, labels, F.lit(True))
    plain = {r["doc_id"]: r["score"] for r in factorisation.score(documents, model).collect()}
    other = documents.withColumn("doc_id", -F.col("doc_id")).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("z"))
    assert {-r["doc_id"]: r["score"] for r in factorisation.score(other, model).collect()} == plain


def test_sum_of_squares_identity():
    reader = factorisation.Reader()
    x = reader.read_all(["one two three", "", "two words !!", "A | b | c"])
    rng = np.random.default_rng(0)
    width = factorisation.BUCKETS + factorisation.N_STATS * factorisation.BINS
    machine = factorisation.Machine(factorisation.quantile_cuts(x.stats, factorisation.BINS), 0.3, rng.normal(size=width),
                                    rng.normal(size=(width, factorisation.RANK)))
    index, value, row = machine.inputs(x)
    got = machine.score(x)
    for i in range(4):
        at = [(a, b) for a, b, r in zip(index, value, row) if r == i]
        raw = 0.3 + sum(machine.w[a] * b for a, b in at)
        raw += sum(float(machine.v[a] @ machine.v[c]) * b * d for n, (a, b) in enumerate(at) for c, d in at[:n])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit_trees(x[:3000], y[:3000])
    assert auc(model.margin(x[3000:]), y[3000:]) > 0.98
    assert (boosting.fit_trees(x[:0], y[:0]).margin(x[:5]) == 0).all()


def test_isotonic_curve_rises_and_fits():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=20_000)
    p = 1 / (1 + np.exp(-2 * margin))
    curve = boosting.fit_isotonic(margin, (rng.uniform(size=20_000) < p).astype(float))
    at = np.linspace(-2, 2, 50)
    assert (np.diff(curve(at)) >= 0).all() and np.abs(curve(at) - 1 / (1 + np.exp(-2 * at))).max() < 0.08


def test_hidden_insults_count():
    learned = toxicity.Lexicon({}).automaton()
    stated = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 1.0)).automaton()
    plain, hidden, apart, clean = (toxicity.features(t, learned, stated) for t in (
        "you are an idiot today", "you are an id1ot today", "you are an i.d.i.o.t today", "you are a friend today"))
    assert plain[4] > 0 and plain[6] > 0 and hidden[9] > 0 and apart[9] > 0
    assert clean[4] == clean[6] == clean[9] == 0
