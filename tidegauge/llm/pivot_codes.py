"""Product codes of vectors, with codebook search by fixed pivots (LAESA).

Every part position has its own codebook and a few pivots, chosen once among
its first entries, each as far as possible from those before it. The distance
of every part to its pivots is taken once and stored beside it. In each round
the distances between pivots and entries follow from the entries alone, and

    d(part, entry) >= |d(part, pivot) - d(pivot, entry)|

for every pivot. A part visits the entries in the order of its largest such
bound, gets exact whole-number distances, and stops at the first bound beyond
the best. Bounds are floating point and stop only with room to spare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.whole_vectors import Sums, finite, floored, matrix, moved, sums_batch
from tidegauge.session import written

PARTS = 16
ENTRIES = 64
PIVOTS = 4
#: Stored distances are single precision: so much of their size, and so much at all, a bound may be too large.
ROOM, UNITS = 1e-6, 1e-3
#: Copies of each label's sum, so that one label's rows need not meet in one task.
SALTS = 32
FAR = np.iinfo(np.int64).max


def choose_pivots(book: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Entries of one codebook, each the farthest from those chosen before, the first at its start."""
    chosen = [0]
    nearest = ((book - book[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((book - book[chosen[-1]]) ** 2).sum(1))
    return book[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    difference = (x[:, None, :] - pivots[None]).astype(float)
    return np.sqrt((difference * difference).sum(2))


class PivotSearch:
    """One codebook and its pivots."""

    def __init__(self, book: np.ndarray, pivots: np.ndarray):
        self.book = book
        self.between = pivot_distances(book, pivots)
        self.evaluated = 0

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the lower index, and the squared distance."""
        n = len(x)
        bound = np.zeros((n, len(self.book)))
        for p in range(to_pivots.shape[1]):
            here, there = to_pivots[:, p, None], self.between[None, :, p]
            np.maximum(bound, np.abs(here - there) - ROOM * (here + there) - UNITS, out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        best, who = np.full(n, FAR), np.full(n, len(self.book))
        alive = np.arange(n)
        for step in range(len(self.book)):
            entry = order[alive, step]
            lowest = bound[alive, entry]
            open_ = lowest * lowest <= best[alive] * (1 + ROOM)
            alive, entry = alive[open_], entry[open_]
            if not alive.size:
                break
            self.evaluated += alive.size
            difference = x[alive] - self.book[entry]
            distance = np.einsum("ij,ij->i", difference, difference)
            better = (distance < best[alive]) | ((distance == best[alive]) & (entry < who[alive]))
            rows = alive[better]
            best[rows], who[rows] = distance[better], entry[better]
        return who, best


def _searches(books: np.ndarray, pivots: np.ndarray) -> list[PivotSearch]:
    return [PivotSearch(b, p) for b, p in zip(books, pivots)]


def _parts(batch: pa.RecordBatch, parts: int, step: int, pivots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, components and pivot distances of every part position; ``x`` and ``far`` are the last columns."""
    n = batch.num_rows
    x = matrix(batch.column(batch.num_columns - 2), parts * step).reshape(n, parts, step)
    far = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, parts, pivots)
    for p in range(parts):
        yield p, x[:, p], far[:, p]


def encode(
    rows: DataFrame, rounds: int = 2, parts: int = PARTS, entries: int = ENTRIES, scale: int = 256, pivots: int = PIVOTS,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per kept vector.

    Rows whose vector is null or holds a null or non-finite component go. A
    component x counts as ``floor(scale * x)``. Codebooks start at the parts of
    the ``entries`` smallest ids and are replaced ``rounds`` times by the
    floored means of their members (entries without members stay), then parts
    are assigned once more. Ties go to the lower index.

    All vectors of a code have one length, that of the smallest id's vector
    among those whose length is a positive multiple of ``parts``; a row of
    another length keeps its place with a null code and error. Rows with equal
    ids are rows of their own, the smaller vector first; a null id is coded but
    starts no entry. Null labels are one label. Without any id to start from,
    codes are null; an empty table gives none. Other columns play no part.
    Components beyond 524,287 raise an error, since distances would not fit a
    long.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    size = F.size("v")
    first = narrow.filter(F.col("vec_id").isNotNull() & (size > 0) & (size % parts == 0)).orderBy("vec_id", "v").select(
        size.alias("n"), floored(F.col("v"), scale).alias("x")
    )
    lead = first.limit(1).collect()
    if not lead:
        nothing = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return narrow.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    width = lead[0]["n"]
    step = width // parts
    start = np.array([r["x"] for r in first.filter(F.col("n") == width).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, step).transpose(1, 0, 2).copy()
    anchors = np.stack([choose_pivots(b, pivots) for b in books])
    pivots = anchors.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width).reshape(batch.num_rows, parts, step)
            far = np.stack([pivot_distances(x[:, p], anchors[p]) for p in range(parts)], axis=1).astype(np.float32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (parts * pivots)), pa.array(far.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "label", "x", "far"])

    whole = narrow.filter(size == width).select("vec_id", "label", floored(F.col("v"), scale).alias("x"))
    measured = written(whole.mapInArrow(measure, whole.select("*").schema.add("far", T.ArrayType(T.FloatType()))), "pivot-distances")

    def add_up(books: np.ndarray):
        held = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = _searches(held.value, anchors)
            sums = [Sums(*b.shape) for b in held.value]
            for batch in batches:
                for p, x, far in _parts(batch, parts, step, pivots):
                    sums[p].add(x, searches[p].nearest(x, far)[0])
            yield sums_batch([row for p, s in enumerate(sums) for row in s.rows(p)])

        return run

    for _ in range(rounds):
        books = moved(books, measured.select("x", "far"), add_up)
    last = spark.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(len(start))], dtype=object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(last.value, anchors)
        for batch in batches:
            code, error = np.full(batch.num_rows, "", dtype=object), np.zeros(batch.num_rows, np.int64)
            for p, x, far in _parts(batch, parts, step, pivots):
                who, distance = searches[p].nearest(x, far)
                code, error = code + digits[who], error + distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    made = whole.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    coded = written(measured.mapInArrow(assign, made), "codes")
    # a null label is a label; structs of one field compare their nulls as equal
    key = F.struct("label").alias("_key")
    sums = coded.groupBy(key).agg(F.sum(F.col("error").cast("decimal(19,0)")).cast("long").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    odd = narrow.filter(size != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return (
        coded.unionByName(odd).select("vec_id", "code", "error", key, salt.alias("_salt"))
        .join(sums, ["_key", "_salt"], "left")
        .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    )
