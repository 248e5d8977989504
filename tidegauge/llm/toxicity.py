"""Toxicity by boosted trees over dense features, calibrated by isotonic regression.

The features are densities: lexicon hits, hits close to a second-person word,
capitals, punctuation, and obfuscation. The lexicon is a short stated list plus
the word beginnings that the labelled sample shows to go with toxic texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from tidegauge.llm.frames import keep_rows, map_column
from tidegauge.llm.labelled import labelled_sample
from tidegauge.llm.words import plain_words

#: Labelled rows that the model is fitted on, at most about.
BOUND = 20_000
THRESHOLD = 0.7
NEAR = 4
STEMS = range(3, 9)
LEARNED = 400
#: Log-likelihood ratio from which a word beginning goes with toxic texts beyond chance.
LEAST_RATIO = 15.0
# Common insults and second-person words, stated.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "trash", "garbage", "pathetic", "disgusting", "worthless", "clown", "loser",
    "scum", "jerk", "fool", "ugly", "hate", "filth", "vermin", "coward", "liar", "dummkopf", "blöd", "dumm",
    "abschaum", "connard", "salaud", "imbécile", "crétin", "estúpido", "imbécil", "tonto", "basura",
)
YOU = frozenset(x.encode() for x in (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "ta",
    "vous", "votre", "tú", "ti", "tus", "usted", "ustedes",
))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _SYMBOLS = b"0123456789", b"#$%&*@^_|<>~+="
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b"!?" + _SYMBOLS)
_HIGH = bytes(range(128, 256))
# Signs that stand for letters, and letters kept apart.
_LEET = bytes.maketrans(b"@013457$!", b"aoieastsi")
_APART = re.compile(rb"(?<![a-z0-9])(?:[a-z][.\-_*\x20]){2,}[a-z](?![a-z0-9])")
_INNER = re.compile(rb"[a-z][@013457$!*]+[a-z]")
_LONG = re.compile(rb"([a-z])\1\1")
PIECE = 1 << 20
N_FEATURES = 22


@dataclass
class Lexicon:
    """Word beginnings (whole words end with a space) and their weights."""

    weights: dict[str, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            # on the first letters of a word: the hit is then counted at that word
            body = b" %b" % stem.encode()
            found.add_word(body.decode("latin-1"), (len(body), weight))
        if self.weights:
            found.make_automaton()
        return found


def _line(words: list[bytes]) -> bytes:
    return b" %b " % b" ".join(words)


def hits(automaton: ahocorasick.Automaton, line: bytes) -> dict[int, float]:
    """The largest weight that ends in each word, by the word's place."""
    found = [(end - n + 1, w) for end, (n, w) in automaton.iter(line.decode("latin-1"))] if len(automaton) else []
    if not found:
        return {}
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    best: dict[int, float] = {}
    for word, (_, weight) in zip(np.searchsorted(spaces, [at for at, _ in found]).tolist(), found):
        best[word] = max(best.get(word, -1.0), weight)
    return best


def stems(text: str | None) -> set[str]:
    """The beginnings of the words of a text, and whole words with a space behind."""
    words = {w.decode() for w in plain_words((text or "").encode())}
    return {w[:n] for w in words for n in STEMS if len(w) >= n} | {f"{w} " for w in words if len(w) >= min(STEMS)}


def features(text: str | None, learned: ahocorasick.Automaton, stated: ahocorasick.Automaton) -> list[float]:
    """Dense features of a whole text; all zero for an empty one."""
    data = (text or "").encode()
    n_words = you = near = 0
    plain: Counter = Counter()
    spaced = inner = long = 0
    for start in range(0, max(1, len(data)), PIECE):
        # bounded pieces; a word at a border counts in both halves
        low = data[start : start + PIECE].lower()
        words = plain_words(low)
        if not words:
            continue
        line = _line(words)
        own, seed = hits(learned, line), hits(stated, line)
        n_words += len(words)
        second = [i for i, w in enumerate(words) if w in YOU]
        you += len(second)
        if second and (own or seed):
            at = np.array(second)
            for i in own.keys() | seed.keys():
                k = np.searchsorted(at, i)
                near += min(abs(int(at[j]) - i) for j in (k - 1, min(k, at.size - 1)) if j >= 0) <= NEAR
        inside = len(_INNER.findall(low))
        kept = _APART.findall(low)
        if inside or kept:
            clean = _APART.sub(lambda m: re.sub(rb"[^a-z]", b"", m[0]), low.translate(_LEET))
            again = _line(plain_words(clean))
            plain["hidden"] += max(0, len(hits(learned, again)) + len(hits(stated, again)) - len(own) - len(seed))
        plain["own"] += len(own)
        plain["seed"] += len(seed)
        plain["weight"] += sum(own.values())
        plain["top"] = max(plain["top"], *own.values()) if own else plain["top"]
        spaced, inner, long = spaced + len(kept), inner + inside, long + len(_LONG.findall(low))
    size, n = max(1, len(data)), max(1, n_words)
    without = len(data)
    upper, lower = (without - len(data.translate(None, c)) for c in (_UPPER, _LOWER))
    rates = [(without - len(data.translate(None, c))) / size for c in (_DIGITS, _SYMBOLS, _PUNCTUATION, b"!", b"?", _HIGH)]
    return [
        plain["own"] / n, np.log1p(plain["own"]), plain["weight"] / n, plain["top"], plain["seed"] / n,
        np.log1p(plain["seed"]), near / n, np.log1p(near), you / n, plain["hidden"] / n, spaced / n, inner / n, long / n,
        upper / max(1, upper + lower), *rates, np.log1p(n_words), size / n,
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    curve: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.trees.margin(self.features(texts))
        # a small share of the uncalibrated value keeps the order inside a flat block
        return np.clip(0.98 * self.curve(margin) + 0.02 / (1 + np.exp(-margin)), 0, 1)

    def features(self, texts: list[str | None]) -> np.ndarray:
        learned, stated = self.automata()
        return np.array([features(t, learned, stated) for t in texts], float).reshape(len(texts), N_FEATURES)

    def automata(self):
        if not hasattr(self, "_automata"):
            self._automata = self.lexicon.automaton(), Lexicon(dict.fromkeys(INSULTS, 1.0)).automaton()
        return self._automata

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automata"}


def learn_lexicon(sample: DataFrame, most: int = LEARNED, least: float = LEAST_RATIO) -> Lexicon:
    """The word beginnings that go most clearly with toxic texts, by log-likelihood ratio of the texts that have them.

    Their weight is the log-odds. Counts combine in each task before the
    shuffle; only ``most`` rows come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for stem in stems(text):
                    found.setdefault(stem, [0, 0])[y] += 1
            kept = [(s, a, b) for s, (a, b) in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["stem", "clean", "toxic"],
            )

    size = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = size[0], size[1] - size[0]
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(toxic + 1.0) - F.col("toxic"))) - F.log(
        (F.col("clean") + 0.5) / (F.lit(clean + 1.0) - F.col("clean"))
    )
    both = F.col("toxic") + F.col("clean")
    cells = (
        (F.col("toxic"), toxic, both), (F.col("clean"), clean, both),
        (F.lit(toxic) - F.col("toxic"), toxic, F.lit(size[1]) - both),
        (F.lit(clean) - F.col("clean"), clean, F.lit(size[1]) - both),
    )
    ratio = sum(
        (F.when(seen > 0, 2 * seen * F.log(seen * float(size[1]) / (of * column))).otherwise(0.0) for seen, of, column in cells),
        F.lit(0.0),
    )
    rows = (
        sample.select("text", "y").mapInArrow(count, "stem string, clean long, toxic long")
        .groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .select("stem", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("ratio") >= least) & (F.col("odds") >= 1.0))
        .orderBy(F.desc("ratio"), "stem").limit(most).collect()
    )
    return Lexicon({r["stem"]: float(r["odds"]) for r in rows})


def fit(sample: DataFrame) -> Model:
    """Half of the sample gives the lexicon, a third of the rest the calibration, the others the trees."""
    lot = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(6))
    lexicon = learn_lexicon(sample.filter(lot < 3))
    model = Model(lexicon, None, None)

    def rows(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.features(texts.to_pylist()).tolist(), pa.list_(pa.float64()))]

    held = map_column(sample.filter(lot >= 3).select((lot == 3).alias("curve"), "y", "text"), "text", "x array<double>", rows)
    table = held.toArrow()
    y = table.column("y").to_numpy().astype(float)
    x = np.array(table.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    curve = table.column("curve").to_numpy(zero_copy_only=False)
    order = np.lexsort(x.T) if len(y) else np.empty(0, int)  # the same model whatever order the rows came in
    x, y, curve = x[order], y[order], curve[order]
    model.trees = fit_trees(x[~curve], y[~curve])
    model.curve = fit_isotonic(model.trees.margin(x[curve]), y[curve])
    return model


def train(docs: DataFrame, labels: DataFrame, training: Column, bound: int = BOUND) -> Model:
    """Fit on at most about ``bound`` labelled rows for which ``training`` holds."""
    return fit(labelled_sample(docs, labels, "toxic", training, bound))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row; a null text counts as empty and is scored like any other.

    Null and repeated ids keep their rows; other columns play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        found = held.value.score(texts.to_pylist())
        return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_column(narrow, "text", "score double, predicted int", per_batch)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below ``threshold``; all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts: pc.less(pa.array(held.value.score(texts.to_pylist())), threshold))
