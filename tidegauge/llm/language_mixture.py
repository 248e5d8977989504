"""Language identification as a mixture: which languages, in which proportions, make up a text.

Every language is a distribution over letter n-grams, counted over all training
texts. A text's grams are drawn from an unknown mixture of these, whose
proportions are estimated by expectation-maximisation:

    share_l  <-  sum over grams of count / total * share_l p(gram | l) / sum_m share_m p(gram | m).

The set of languages is chosen by penalised likelihood: from the full mixture
the smallest share goes, and the proportions of the rest are estimated again,
as long as that costs less likelihood than a language has to pay for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
#: Bytes in a gram; one in the middle is never a space.
GRAM = 3
BUCKETS = 1 << 16
#: Added to the count of every bucket of every language.
SMOOTH = 0.1
ROUNDS = 40
#: A mixture is settled when no share moves by more.
SETTLED = 1e-4
#: What a language pays, in units of half the logarithm of the grams; neighbouring grams overlap by GRAM - 1.
PRICE = float(GRAM)
#: Bytes of text whose grams are held at once.
STRETCH = 1 << 20
#: Languages a model may have: it is sent to every executor.
MOST_LANGUAGES = 1024

# ASCII bytes that are no letters count as a space; bytes of other characters stay.
_LETTERS = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)], np.uint8)


def _hashed(window: np.ndarray) -> np.ndarray:
    """Buckets of the grams around each byte of ``window`` but the first and the last, -1 where that is a space."""
    x = window.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((code * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64) % BUCKETS
    bucket[window[1:-1] == 0x20] = -1
    return bucket


@dataclass
class Grams:
    """``count`` times ``bucket`` in text ``row``; rows rise, and every row of ``n`` may lack entries."""

    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    n: int


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts end to end, and where each one starts; a null text is empty."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    held = low.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return _LETTERS[data], offsets - offsets[0]


def _one_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one long text, read piece by piece with a byte of its surroundings on both sides."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, data.size, STRETCH):
        piece = np.full(min(STRETCH, data.size - at) + 2, 0x20, np.uint8)
        piece[1:-1] = data[at : at + STRETCH]
        if at:
            piece[0] = data[at - 1]
        if at + STRETCH < data.size:
            piece[-1] = data[at + STRETCH]
        found = _hashed(piece)
        counts += np.bincount(found[found >= 0], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def _several(data: np.ndarray, start: np.ndarray) -> Grams:
    """Texts that lie end to end in ``data``, with a space put between them."""
    n = len(start) - 1
    row = np.repeat(np.arange(n), np.diff(start))
    spaced = np.full(data.size + n + 1, 0x20, np.uint8)
    spaced[np.arange(data.size) + row + 1] = data
    owner = np.zeros(spaced.size, np.int64)
    owner[np.arange(data.size) + row + 1] = row
    found = _hashed(spaced)
    good = found >= 0
    key, count = np.unique(owner[1:-1][good] * BUCKETS + found[good], return_counts=True)
    return Grams(key // BUCKETS, key % BUCKETS, count, n)


def stretches(texts: pa.Array) -> Iterator[tuple[int, Grams]]:
    """Grams of the texts in runs of about :data:`STRETCH` bytes, with the place of the first; a longer text is a run."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        total, end = int(sizes[at]), at + 1
        while end < len(texts) and total + sizes[end] <= STRETCH:
            total, end = total + int(sizes[end]), end + 1
        data, start = _bytes_of(texts.slice(at, end - at))
        if data.size > STRETCH:
            bucket, count = _one_long(data)
            yield at, Grams(np.zeros(bucket.size, np.int64), bucket, count, 1)
        else:
            yield at, _several(data, start)
        at = end


@dataclass
class Mixture:
    """Languages in the order of their names, and the probability of every bucket in each."""

    names: list[str]
    chance: np.ndarray

    def fit(self, g: Grams, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the ``allowed`` languages of each row, and the log likelihood; rows without grams keep even shares."""
        share = allowed / allowed.sum(1, keepdims=True)
        chance = self.chance[g.bucket]
        likelihood = np.zeros(g.n)
        if not g.row.size:
            return share, likelihood
        rows, first = np.unique(g.row, return_index=True)
        total = np.add.reduceat(g.count, first).astype(float)
        # only texts that still move are estimated again
        moving, mine, p, c, at = rows, g.row, chance, g.count, first
        for _ in range(ROUNDS):
            weighted = share[mine] * p
            mixed = weighted.sum(1)
            after = np.add.reduceat(weighted * (c / mixed)[:, None], at, axis=0) / total[:, None]
            moved = np.abs(after - share[moving]).max(1) > SETTLED
            share[moving] = after
            if not moved.any():
                break
            if not moved.all():
                still = np.repeat(moved, np.diff(np.append(at, mine.size)))
                moving, total = moving[moved], total[moved]
                mine, p, c = mine[still], p[still], c[still]
                at = np.unique(mine, return_index=True)[1]
        mixed = (share[g.row] * chance).sum(1)
        likelihood[rows] = np.add.reduceat(g.count * np.log(mixed), first)
        return share, likelihood

    def select(self, g: Grams) -> np.ndarray:
        """Shares of the languages that each row keeps, zero for the others."""
        size = np.bincount(g.row, g.count, g.n)
        price = PRICE * 0.5 * np.log(np.maximum(size, 2.0))
        allowed = np.ones((g.n, len(self.names)), bool)
        share, likelihood = self.fit(g, allowed)
        open_ = np.flatnonzero(allowed.sum(1) > 1)
        while open_.size:
            # what has no share costs nothing to leave out: all of those go at once, else the smallest share
            fewer = allowed[open_] & (share[open_] > SETTLED)
            none = ~(fewer.sum(1) < allowed[open_].sum(1))
            smallest = np.where(allowed[open_], share[open_], np.inf).argmin(1)
            fewer[none, smallest[none]] = False
            left_out = allowed[open_].sum(1) - fewer.sum(1)
            again, less = self.fit(_rows(g, open_), fewer)
            accept = likelihood[open_] - less < price[open_] * left_out
            taken = open_[accept]
            allowed[taken], share[taken], likelihood[taken] = fewer[accept], again[accept], less[accept]
            open_ = taken[allowed[taken].sum(1) > 1]
        return share


def _rows(g: Grams, rows: np.ndarray) -> Grams:
    """The grams of some rows, numbered by their place among them."""
    place = np.full(g.n, -1)
    place[rows] = np.arange(rows.size)
    kept = place[g.row] >= 0
    return Grams(place[g.row[kept]], g.bucket[kept], g.count[kept], rows.size)


def train(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> Mixture:
    """Distributions of all languages, from every row with a text and a language for which ``training`` holds.

    Each task adds up its own rows, tasks are added up per language and bucket,
    so the driver gets at most one number for each of these; more than
    :data:`MOST_LANGUAGES` languages raise an error. Repeated rows count as
    often as they occur. An empty table gives a model without languages.
    """
    used = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & training).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            names, of = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
            for name in names:
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))
            for at, g in stretches(batch.column(1)):
                whose = of[at + g.row]
                for i in np.unique(whose):
                    mine = whose == i
                    totals[names[i]] += np.bincount(g.bucket[mine], g.count[mine], BUCKETS).astype(np.int64)
        for name, total in totals.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * bucket.size, pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])],
                names=["lang", "bucket", "n"],
            )

    counted = used.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_language = counted.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    rows = sorted(per_language.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chance = np.full((BUCKETS, len(rows)), SMOOTH)
    for i, r in enumerate(rows):
        chance[np.array(r["bucket"]), i] += r["n"]
    return Mixture([r["lang"] for r in rows], chance / chance.sum(0))


def identify(docs: DataFrame, model: Mixture, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, shares)`` for every row.

    ``shares`` are the proportions of the languages found, by grams;
    ``lang_pred`` is the one with the largest (ties: the smaller name) and
    ``score`` its share. A text that is null or has no letter is
    :data:`UNDETERMINED` with score 0 and no shares, as is every text if the
    model has no language; letters that no training text has make even shares. Very long texts are read piece by piece. Null and
    repeated ids keep their rows; other columns play no part; an empty table
    gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = held.value
        for batch in batches:
            texts = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            shares: list[list[tuple[str, float]]] = [[] for _ in names]
            for at, g in stretches(texts) if mixture.names else ():
                found = mixture.select(g)
                best = found.argmax(1)
                for i in np.flatnonzero(lettered[at : at + g.n]):
                    names[at + i], score[at + i] = mixture.names[best[i]], min(1.0, found[i, best[i]])
                    shares[at + i] = [(mixture.names[j], float(found[i, j])) for j in np.flatnonzero(found[i])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = narrow.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("shares", T.MapType(T.StringType(), T.DoubleType()))
    return narrow.mapInArrow(predict, schema)
