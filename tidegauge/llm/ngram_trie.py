"""An n-gram language model as a trie of Elias-Fano levels, one set of levels per file.

Words and contexts are known by their 64-bit hashes. A shard holds the words
and the contexts that hash to it: for each level the sorted contexts, monotone
pointers to their successors, and the successors themselves, coded relative to
their context (the context's number above, 40 bits of the successor's hash
below), so that a word is looked for only among the successors of its context.
Discounted probabilities are quantised to eight bits. The files are written to
the shared folder and memory-mapped by the tasks that score.

Counts are made from all training texts, without pruning. A task counts its
texts piece by piece and sends each shard one compact row per piece. Contexts
that are very frequent in all training texts, as a pass before finds them, are
spread over all shards by their successors.
"""

from __future__ import annotations

import json
import pickle
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.elias_fano import Sequence, encode
from tidegauge.llm.words import word_lists
from tidegauge.session import fresh_path, written

ORDER = 2
DISCOUNT = 0.75
#: Bytes of text for one shard, and tokens that are counted or scored at once.
SHARD_BYTES = 16 << 20
TOKENS_AT_ONCE = 1_000_000
U64 = np.uint64
KEEP = U64(24)
#: Quantised log10 of a probability: steps of 1/32 from 0 downward.
STEP = 1 / 32
END, START = b"", b" "


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a longer context."""
    x = (context * U64(0x9E3779B97F4A7C15)) ^ (word + U64(0x632BE59BD9B4E019))
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Grams:
    """The n-grams of some texts, with each distinct one numbered per level.

    ``word[i]`` is the number of token i; ``context[k]`` and ``follows[k]`` are
    the context hash and the word of every distinct gram of level k, ``of[k]``
    its number at every token.
    """

    def __init__(self, texts: list[str | None], order: int):
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        at, sizes = [], []
        for text in texts:
            n = 1
            for words in word_lists(text):
                at.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                n += len(words)
            at.append(np.array([numbers[END]]))
            sizes.append(n)
        self.word = np.concatenate(at) if at else np.empty(0, np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hash = np.array([word_hash(w) for w in numbers], U64)
        self.words = list(numbers)
        self.context, self.follows, self.first, self.of, self.counts = {}, {}, {}, {}, {}
        here = np.zeros(len(self.word), np.int64)  # number of the context of each token
        hashes = np.array([word_hash(START)], U64)
        last, last_hash = self.word, self.hash
        begins = self.start[:-1]
        for level in range(2, order + 1):
            # the context of a token is the gram, one level lower, that ends before it
            here = np.empty(len(self.word), np.int64)
            here[1:] = last[:-1]
            start = len(last_hash)
            here[begins] = start
            hashes = np.append(last_hash, U64(word_hash(START)))
            key = here * (len(self.hash) + 1) + self.word
            unique, first, of, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.context[level] = hashes[unique // (len(self.hash) + 1)]
            self.follows[level] = unique % (len(self.hash) + 1)
            self.first[level], self.of[level], self.counts[level] = first, of, counts
            last, last_hash = of, mixed(self.context[level], self.hash[self.follows[level]])
        self.word_counts = np.bincount(self.word, minlength=len(self.hash))


def shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.isin(context, hot)
    return (np.where(spread, mixed(context, word), context) % U64(shards)).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: int, tokens: int = TOKENS_AT_ONCE) -> Iterator[tuple[list, list]]:
    """Rows in lists of bounded text, with the rows' other values: ``(texts, rows)``."""
    texts, rows, size = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != column]
        for text, *row in zip(batch.column(column).to_pylist(), *others):
            texts.append(text)
            rows.append(row)
            size += len(text or "") // 5 + 1
            if size >= tokens:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def count_rows(texts: list, order: int, hot: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """``(shard, counts)``: the counts of some texts, one row per shard."""
    grams = Grams(texts, order)
    parts: dict[int, dict] = defaultdict(dict)
    home = (grams.hash % U64(shards)).astype(np.int64)
    for shard, chosen in _groups(home, grams.hash):
        parts[shard][1] = grams.hash[chosen], _narrow(grams.word_counts[chosen])
    for level in range(2, order + 1):
        context, word = grams.context[level], grams.hash[grams.follows[level]]
        for shard, chosen in _groups(shard_of(context, word, hot, shards), context):
            own, sizes = _runs(context[chosen])
            low = (word[chosen] >> KEEP)
            parts[shard][level] = (
                own, _narrow(sizes), (low & U64(0xFFFFFFFF)).astype(np.uint32), (low >> U64(32)).astype(np.uint8),
                _narrow(grams.counts[level][chosen]),
            )
    for shard, part in parts.items():
        yield shard, pickle.dumps(part, protocol=5)


def frequent(texts: list, order: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Contexts that are at least ``share`` of the grams of their level in some texts, how often they come, and the number of tokens."""
    grams = Grams(texts, order - 1)
    hashes, counts = [grams.hash], [grams.word_counts]
    for level in range(2, order):
        hashes.append(mixed(grams.context[level], grams.hash[grams.follows[level]]))
        counts.append(grams.counts[level])
    found, often = np.concatenate(hashes), np.concatenate(counts)
    many = often >= share * len(grams.word)
    return found[many], often[many], len(grams.word)


def hot_contexts(texts: DataFrame, order: int, shards: int) -> np.ndarray:
    """Every context with a share of ``1 / (4 * shards)`` or more of all tokens, and none with less than half of it.

    A piece reports contexts from half that share on. What pieces leave out of
    a context is less than half the share of all tokens, so the reported sum of
    one that has the share reaches the other half. At most ``8 * shards``
    contexts of a level come to the driver.
    """
    half = 1 / (8 * shards)

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in pieces(batches, 0):
            found, often, tokens = frequent(some, order, half)
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *found.view(np.int64).tolist()], pa.int64()), pa.array([tokens, *often.tolist()], pa.int64())
            ], ["context", "n"])

    sums = written(texts.mapInArrow(reported, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")), "frequent")
    tokens = sums.filter("context is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = sums.filter(F.col("context").isNotNull() & (F.col("n") >= half * tokens)).select("context").collect()
    return np.unique(np.append(np.array([r[0] for r in rows], np.int64).view(U64), U64(word_hash(START))))


def _groups(of: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((key, of))
    for chosen in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if chosen.size:
            yield int(of[chosen[0]]), chosen


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    at = np.flatnonzero(new)
    return sorted_values[at], np.diff(np.append(at, len(sorted_values)))


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if at.size else counts


def build_shard(rows: list[bytes], order: int, discount: float, hot: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    """The levels of one shard as named arrays, and its totals."""
    parts = [pickle.loads(r) for r in rows]
    arrays: dict[str, np.ndarray] = {}
    own = [p[1] for p in parts if 1 in p]
    words, counts = _summed([_joined([w for w, _ in own], U64)], _joined([c for _, c in own], np.int64))
    arrays |= _named("words", encode(words[0], 2**64))
    codebook, codes = np.unique(counts, return_inverse=True)
    arrays |= {"counts.values": codebook, "counts.codes": _narrow(codes)}
    totals: dict = {"tokens": int(counts.sum()), "words": len(counts), "hot": {}}
    for level in range(2, order + 1):
        own = [p[level] for p in parts if level in p]
        context = _joined([np.repeat(k, n.astype(np.int64)) for k, n, *_ in own], U64)
        low = _joined([(h.astype(U64) << U64(32)) | x.astype(U64) for _, _, x, h, _ in own], U64)
        (context, low), counts = _summed([context, low], _joined([x[4] for x in own], np.int64))
        keys, sizes = _runs(context)
        sums = np.add.reduceat(counts, np.cumsum(sizes) - sizes) if len(keys) else np.empty(0, np.int64)
        number = np.repeat(np.arange(len(keys), dtype=U64), sizes)
        share = (counts - discount) / np.repeat(sums, sizes)
        # rounded down, so that the shares of a context never add up to more than one
        steps = np.clip(np.ceil(-np.log10(share) / STEP), 0, 255).astype(np.uint8)
        book, codes = np.unique(sums, return_inverse=True)
        arrays |= _named(f"contexts{level}", encode(keys, 2**64))
        arrays |= _named(f"pointers{level}", encode(np.append(0, np.cumsum(sizes)), len(context) + 1))
        arrays |= _named(f"successors{level}", encode((number << U64(40)) | low, max(1, len(keys)) << 40))
        arrays |= {f"shares{level}": steps, f"sums{level}.values": book, f"sums{level}.codes": _narrow(codes)}
        spread = np.isin(keys, hot)
        totals["hot"][level] = keys[spread], sums[spread], sizes[spread]
    return arrays, totals


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def save(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Write arrays as one file, whole or not at all; a repeated task writes the same file."""
    head, at = {}, 0
    for name, array in arrays.items():
        head[name] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for array in arrays.values():
            out.write(array.tobytes() + bytes(-array.nbytes % 8))
    files.move(attempt, path)
    return at


def load(uri: str) -> dict[str, np.ndarray]:
    """Map a file of :func:`save`. One that is not on a mounted file system is first copied to an unnamed local file."""
    if urlparse(uri).scheme in ("", "file"):
        data = np.memmap(urlparse(uri).path, np.uint8, "r")
    else:
        files, path = pafs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as copy:
            with files.open_input_stream(path) as source:
                while chunk := source.read(1 << 22):
                    copy.write(chunk)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
    size = int(data[:8].view(np.int64)[0])
    out = {}
    for name, (kind, at, n) in json.loads(data[8 : 8 + size].tobytes()).items():
        begin = 8 + size + at
        out[name] = data[begin : begin + n * np.dtype(kind).itemsize].view(kind)
    return out


@dataclass
class Shard:
    """One mapped file."""

    arrays: dict[str, np.ndarray]

    def __post_init__(self):
        self.sequences = {
            name: Sequence({k.split(".")[1]: v for k, v in self.arrays.items() if k.startswith(f"{name}.")})
            for name in {k.split(".")[0] for k in self.arrays if k.endswith(".upper")}
        }

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        at = self.sequences["words"].find(hashes)
        out = np.zeros(len(hashes), np.int64)
        out[at >= 0] = self.arrays["counts.values"][self.arrays["counts.codes"][at[at >= 0]]]
        return out

    def level(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: the context's sum here, its number of successors here, and the pair's share of that sum.

        ``context`` must be sorted.
        """
        keys, sizes = _runs(context)
        place = self.sequences[f"contexts{level}"].find(keys)
        known = np.flatnonzero(place >= 0)
        total, fan = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin = np.zeros(len(keys), np.int64)
        if known.size:
            pointers = self.sequences[f"pointers{level}"]
            begin[known] = pointers.access(place[known]).astype(np.int64)
            fan[known] = pointers.access(place[known] + 1).astype(np.int64) - begin[known]
            total[known] = self.arrays[f"sums{level}.values"][self.arrays[f"sums{level}.codes"][place[known]]]
        each = np.repeat(np.arange(len(keys)), sizes)
        share = np.zeros(len(context))
        asked = np.flatnonzero(place[each] >= 0)
        if asked.size:
            k = each[asked]
            target = (place[k].astype(U64) << U64(40)) | (word[asked] >> KEEP)
            found = self.sequences[f"successors{level}"].find(target, begin[k], begin[k] + fan[k])
            hit = found >= 0
            share[asked[hit]] = 10.0 ** (-STEP * self.arrays[f"shares{level}"][found[hit]].astype(float))
        return total[each], fan[each], share


@dataclass
class Model:
    """Where the shards are, and the totals that hold for all of them."""

    folder: str
    shards: int
    order: int
    discount: float
    tokens: int
    words: int
    hot: dict[int, dict[int, tuple[int, int]]]
    present: frozenset[int]

    def hot_hashes(self) -> np.ndarray:
        return np.array(sorted({k for level in self.hot.values() for k in level}), U64)


_open: dict[str, Shard] = {}


def opened(model: Model, shard: int) -> Shard:
    """A shard of the model, mapped once per worker process; other models' shards are let go."""
    uri = f"{model.folder}/{shard}"
    if uri not in _open:
        for other in [k for k in _open if not k.startswith(f"{model.folder}/")]:
            del _open[other]
        _open[uri] = Shard(load(uri))
    return _open[uri]


def probabilities(model: Model, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Of every distinct word its count, and of every token the model's probability."""
    counts = np.zeros(len(grams.hash), np.int64)
    for shard, chosen in _groups((grams.hash % U64(model.shards)).astype(np.int64), grams.hash):
        if shard in model.present:
            counts[chosen] = opened(model, shard).word_counts(grams.hash[chosen])
    p = ((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))[grams.word]
    spread = model.hot_hashes()
    for level in range(2, model.order + 1):
        context, word = grams.context[level], grams.hash[grams.follows[level]]
        total, fan = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        share = np.zeros(len(context))
        for shard, chosen in _groups(shard_of(context, word, spread, model.shards), context):
            if shard in model.present:
                total[chosen], fan[chosen], share[chosen] = opened(model, shard).level(level, context[chosen], word[chosen])
        for key, (sums, successors) in model.hot.get(level, {}).items():
            own = context == U64(key)
            share[own] *= total[own] / sums
            total[own], fan[own] = sums, successors
        shorter = p[grams.first[level]]
        seen = total > 0
        left = np.ones(len(context))
        left[seen] = model.discount * fan[seen] / total[seen]
        p = (share + left * shorter)[grams.of[level]]
    return counts, p


def train(
    docs: DataFrame, training: Column, text: str = "text", order: int = ORDER, discount: float = DISCOUNT,
    shard_bytes: int = SHARD_BYTES,
) -> Model:
    """Count all texts for which ``training`` holds, and write the trie to the shared folder.

    Null texts count as empty: an end token alone. Only totals per shard and
    those of the few very frequent contexts come to the driver.
    """
    spark = docs.sparkSession
    texts = docs.filter(training).select(F.col(text).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    # with one shard there is nothing to spread over
    hot = hot_contexts(texts, order, shards) if shards > 1 else np.array([word_hash(START)], U64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in pieces(batches, 0):
            for shard, part in count_rows(some, order, hot, shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.binary())], ["shard", "counts"])

    folder = fresh_path(spark, "ngram-trie")

    def built(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        arrays, totals = build_shard(table.column("counts").to_pylist(), order, discount, hot)
        save(f"{folder}/{shard}", arrays)
        rows = [(0, np.zeros(1, U64), np.array([totals["tokens"]]), np.array([totals["words"]]))]
        rows += [(level, *hot_rows) for level, hot_rows in totals["hot"].items()]
        return pa.table({
            "shard": pa.array(np.full(sum(len(r[1]) for r in rows), shard, np.int32)),
            "level": pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int32)),
            "key": pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)),
            "sums": pa.array(np.concatenate([r[2] for r in rows]).astype(np.int64)),
            "fan": pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)),
        })

    made = written(
        texts.mapInArrow(counted, "shard int, counts binary").groupBy("shard")
        .applyInArrow(built, "shard int, level int, key long, sums long, fan long"),
        "trie-totals",
    )
    hot_totals: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    hot_sums = made.filter("level > 0").groupBy("level", "key").agg(F.sum("sums").alias("sums"), F.sum("fan").alias("fan"))
    for r in hot_sums.collect():
        hot_totals[r["level"]][r["key"] % 2**64] = r["sums"], r["fan"]
    per_shard = made.filter("level = 0").collect()
    tokens, words = sum(r["sums"] for r in per_shard), sum(r["fan"] for r in per_shard)
    return Model(folder, shards, order, discount, tokens, words, dict(hot_totals), frozenset(r["shard"] for r in per_shard))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    A null or empty text is its end token alone. Null and repeated ids keep
    their rows; other columns play no part. With no training text all words are
    unknown.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = held.value
        for texts, rows in pieces(batches, 1):
            grams = Grams(texts, lm.order)
            counts, p = probabilities(lm, grams)
            base = np.log10((counts + 0.5) / (lm.tokens + 0.5 * (lm.words + 1)))[grams.word]
            start, n = grams.start[:-1], len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], kind), pa.array(np.diff(grams.start)),
                pa.array(np.add.reduceat((counts > 0)[grams.word].astype(np.int64), start)),
                pa.array(np.full(n, lm.tokens)), pa.array(np.add.reduceat(base, start)),
                pa.array(np.add.reduceat(np.log10(p), start)),
            ], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.int64() if dict(narrow.dtypes)["doc_id"] == "bigint" else pa.string()
    return narrow.mapInArrow(
        scored, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
