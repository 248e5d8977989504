"""A factorisation machine on hashed words, structure statistics and metadata.

Pairs of inputs interact through short vectors, and the sum over all pairs is
half the difference of the square of the sum and the sum of the squares, so a
text is scored in time linear in its inputs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.frames import keep_rows, map_column
from tidegauge.llm.labelled import binned, labelled_sample, quantile_cuts
from tidegauge.llm.words import word_lists

#: Labelled rows that the model is fitted on, at most about.
BOUND = 12_000
THRESHOLD = 0.3
BUCKETS = 1 << 15
BINS = 12
RANK = 8
REMEMBERED = 500_000
#: Bytes of text whose inputs are held at once.
STRETCH = 1 << 20
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS = b"#$%&*@^_|<>~+=\\"
_ENDS = b"!#$%&*|"
_HIGH = bytes(range(128, 256))
N_STATS = 20


@dataclass
class Inputs:
    """Sparse inputs of some texts: ``index`` and ``value`` of text i are at ``start[i]`` to ``start[i + 1]``."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray
    stats: np.ndarray

    def take(self, rows: np.ndarray) -> Inputs:
        sizes = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], sizes)
        return Inputs(self.index[at], self.value[at], start, self.stats[rows])


class Reader:
    """Texts to hashed words and statistics, word by word over the whole text."""

    def __init__(self):
        self.buckets: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        found = self.buckets.get(word)
        if found is None:
            if len(self.buckets) >= REMEMBERED:
                self.buckets.clear()
            found = self.buckets[word] = xxhash.xxh32_intdigest(word) % BUCKETS
        return found

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        data = text.encode()
        counts: Counter = Counter()
        n = same = marked = short = 0
        for words in word_lists(text):
            counts.update(words)
            n += len(words)
            same += sum(map(eq, words, words[1:]))
            marked += sum(w[-1] in _ENDS for w in words)
            short += sum(len(w) <= 2 for w in words)
        lines = data.split(b"\n")
        size, m = max(1, len(data)), max(1, n)
        share = [(len(data) - len(data.translate(None, c))) for c in (_UPPER, _LOWER, _DIGITS, _SYMBOLS, b"!", b"|", b".,", _HIGH)]
        stats = [
            np.log1p(n), np.log1p(len(text)), size / m, len(counts) / m, max(counts.values(), default=0) / m, same / m,
            marked / m, short / m, len(lines) / m, len(set(lines)) / len(lines), max(map(len, lines)) / size,
            share[0] / max(1, share[0] + share[1]), *[x / size for x in share[1:]], n / max(1, len(counts)) ** 0.5,
        ]
        hashed: Counter = Counter()
        for word, c in counts.items():
            hashed[self.bucket(word)] += c
        value = 1 + np.log(np.fromiter(hashed.values(), float, len(hashed)))
        norm = np.sqrt((value**2).sum()) if len(hashed) else 1.0
        return np.fromiter(hashed.keys(), np.int64, len(hashed)), value / norm, stats

    def read_all(self, texts: list[str | None]) -> Inputs:
        read = [self.read(t) for t in texts]
        sizes = [len(r[0]) for r in read]
        joined = [np.concatenate([r[i] for r in read]) if read else np.empty(0) for i in (0, 1)]
        return Inputs(
            joined[0].astype(np.int64), joined[1], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            np.array([r[2] for r in read], float).reshape(len(read), N_STATS),
        )


@dataclass
class Machine:
    """Weights ``w0``, ``w`` and vectors ``v`` over hashed words and the ranges of each statistic."""

    cuts: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs of each text: its words, and one of the ranges of every statistic."""
        n = len(x.stats)
        sizes = np.diff(x.start) + N_STATS
        start = np.concatenate([[0], np.cumsum(sizes)])
        index, value = np.empty(start[-1], np.int64), np.full(start[-1], N_STATS**-0.5)
        stat = (start[:-1, None] + np.arange(N_STATS)).ravel()
        index[stat] = (BUCKETS + np.arange(N_STATS) * BINS + binned(x.stats, self.cuts)).ravel()
        word = np.ones(start[-1], bool)
        word[stat] = False
        index[word], value[word] = x.index, x.value
        return index, value, np.repeat(np.arange(n), sizes)

    def parts(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int):
        """Sums of the vectors and the raw scores, by the sum-of-squares identity."""
        scaled = self.v[index] * value[:, None]
        first = np.searchsorted(row, np.arange(n))
        sums = np.add.reduceat(scaled, first, axis=0)
        squares = np.add.reduceat((scaled**2).sum(1), first)
        linear = np.add.reduceat(self.w[index] * value, first)
        return scaled, sums, self.w0 + linear + 0.5 * ((sums**2).sum(1) - squares)

    def score(self, x: Inputs) -> np.ndarray:
        if not len(x.stats):
            return np.empty(0)
        return 1 / (1 + np.exp(-self.parts(*self.inputs(x), len(x.stats))[2]))


def fit(x: Inputs, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.3, decay: float = 1e-4) -> Machine:
    """Logistic loss, one adaptive step per batch; the order of the rows is fixed by the caller."""
    random = np.random.default_rng(7)
    width = BUCKETS + N_STATS * BINS
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Machine(quantile_cuts(x.stats, BINS), float(np.log(prior / (1 - prior))), np.zeros(width),
                    random.normal(0, 0.01, (width, RANK)))
    seen_w, seen_v = np.full(width, 1e-3), np.full((width, RANK), 1e-3)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            index, value, row = model.inputs(x.take(rows))
            scaled, sums, raw = model.parts(index, value, row, len(rows))
            slope = (1 / (1 + np.exp(-raw)) - y[rows]) / len(rows) ** 0.5
            used, place = np.unique(index, return_inverse=True)
            each = slope[row] * value
            grad_w = np.bincount(place, each, used.size) + decay * model.w[used]
            grad_v = decay * model.v[used]
            np.add.at(grad_v, place, each[:, None] * (sums[row] - scaled))
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            model.w[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.v[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
            model.w0 -= rate * 0.1 * slope.mean()
    return model


def train(docs: DataFrame, labels: DataFrame, training: Column, bound: int = BOUND) -> Machine:
    """Fit on at most about ``bound`` labelled rows for which ``training`` holds."""
    sample = labelled_sample(docs, labels, "quality", training, bound)
    reader = Reader()

    def rows(texts: pa.Array) -> list[pa.Array]:
        x = reader.read_all(texts.to_pylist())
        cut = [slice(a, b) for a, b in zip(x.start[:-1], x.start[1:])]
        return [
            pa.array([x.index[c].astype(np.int32) for c in cut], pa.list_(pa.int32())),
            pa.array([x.value[c].astype(np.float32) for c in cut], pa.list_(pa.float32())),
            pa.array(x.stats.tolist(), pa.list_(pa.float64())),
        ]

    table = map_column(sample.select("doc_id", "y", "text"), "text", "i array<int>, x array<float>, s array<double>", rows).toArrow()
    table = table.sort_by("doc_id").combine_chunks()  # the same model whatever order the rows came in
    lists = [table.column(c).combine_chunks() for c in ("i", "x")]
    flat = [c.flatten().to_numpy() for c in lists]
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())]) if len(table) else np.zeros(1)
    stats = np.array(table.column("s").to_pylist(), float).reshape(len(table), N_STATS)
    x = Inputs(flat[0].astype(np.int64), flat[1].astype(float), start.astype(np.int64), stats)
    return fit(x, table.column("y").to_numpy().astype(float))


class Scorer:
    """A broadcast model with one reader per worker; texts are read and scored in stretches of bounded size."""

    def __init__(self, held):
        self.held, self.reader = held, None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        self.reader = self.reader or Reader()
        step = max(1, int(len(texts) * STRETCH / max(1, texts.nbytes)))
        parts = [texts.slice(i, step).to_pylist() for i in range(0, len(texts), step)]
        return np.concatenate([np.empty(0), *(self.held.value.score(self.reader.read_all(p)) for p in parts)])


def score(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row; a null text counts as empty and is scored like any other.

    Null and repeated ids keep their rows; other columns play no part.
    """
    scorer = Scorer(docs.sparkSession.sparkContext.broadcast(model))

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        found = scorer(texts)
        return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_column(narrow, "text", "score double, predicted int", per_batch)


def keep_good(docs: DataFrame, model: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``; all columns as they were."""
    scorer = Scorer(docs.sparkSession.sparkContext.broadcast(model))
    return keep_rows(docs, text, lambda texts: pa.array(scorer(texts) >= threshold))
