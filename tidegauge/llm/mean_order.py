"""Lloyd clustering of whole-number vectors by equal-average, equal-variance search.

A vector's component sum and its deviation from its mean bound the distance to
a centroid from below: with width w, sums S and deviations V,

    d^2 >= (S_x - S_c)^2 / w + (V_x - V_c)^2.

Centroids lie sorted by their sum. A vector starts at its own place in that
order and walks outward, always to the side whose sum is nearer. The first
part alone ends the walk, since it only grows; both parts together skip a
centroid; the others get their exact distance in whole numbers. The bounds are
floating point and reject only with room to spare, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.whole_vectors import Sums, finite, floored, matrix, moved, sums_batch
from tidegauge.session import written

#: A bound must exceed the best distance by so much, as a share and in whole units, before it rejects.
ROOM, UNITS = 1e-8, 1.0
FAR = np.iinfo(np.int64).max
#: Goes before an id when it is hashed to choose the first centroids.
SEED = "3:"


def _deviation(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(1, keepdims=True)
    return np.sqrt((centred * centred).sum(1))


class MeanOrder:
    """Centroids in the order of their sums."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.number = np.argsort(sums, kind="stable")
        self.sums = sums[self.number]
        self.entries = centroids[self.number]
        self.deviation = _deviation(self.entries)
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, ties to the smaller number, and the squared distance."""
        n, width = x.shape
        k = len(self.sums)
        best, who = np.full(n, FAR), np.full(n, k)
        total, deviation = x.sum(1), _deviation(x)
        right = np.searchsorted(self.sums, total)
        left = right - 1
        alive = np.arange(n)
        while alive.size:
            a, b = left[alive], right[alive]
            low = np.where(a >= 0, total[alive] - self.sums[np.maximum(a, 0)], np.inf)
            high = np.where(b < k, self.sums[np.minimum(b, k - 1)] - total[alive], np.inf)
            gap = np.minimum(low, high)
            limit = best[alive] * (1 + ROOM) + UNITS
            bound = gap * gap / width
            walks = np.isfinite(gap) & (bound <= limit)
            alive, low, high, a, b, bound, limit = (v[walks] for v in (alive, low, high, a, b, bound, limit))
            down = low <= high
            place = np.where(down, a, b)
            left[alive[down]] -= 1
            right[alive[~down]] += 1
            apart = deviation[alive] - self.deviation[place]
            near = bound + apart * apart <= limit
            rows, place = alive[near], place[near]
            self.evaluated += rows.size
            difference = x[rows] - self.entries[place]
            distance = np.einsum("ij,ij->i", difference, difference)
            number = self.number[place]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = distance[better], number[better]
        return who, best


def kept_vectors(rows: DataFrame, width: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector has ``width`` components, none null or non-finite, written once."""
    v = F.col(vector)
    return written(
        rows.filter(finite(v) & (F.size(v) == width)).select(F.col(vec_id).alias("vec_id"), floored(v, scale).alias("x")), "kept"
    )


def first_centroids(kept: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash smallest, fewer if there are fewer."""
    order = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    seeds = kept.filter(F.col("vec_id").isNotNull()).select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), width)


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per kept vector.

    Kept are vectors of ``width`` components without a null or non-finite one;
    a component x counts as ``floor(scale * x)``. Centroids start at the ``k``
    kept vectors whose ids hash smallest, are replaced ``rounds`` times by the
    floored means of their members (those without members stay), and every
    vector is assigned once more. Ties go to the smaller number.

    Rows with equal ids are rows of their own; among them the smaller vector
    starts first. A null id is assigned like any other but starts no centroid;
    if no row has an id, ``cluster`` and what follows from it is null. An empty
    table gives none; other columns play no part. Components beyond 131,071
    raise an error, since distances would not fit a long.
    """
    spark = rows.sparkSession
    kept = kept_vectors(rows, width, scale, vec_id, vector)
    centroids = first_centroids(kept, k, width)
    if not len(centroids):
        names = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in names.items()])

    def add_up(books: np.ndarray):
        held = spark.sparkContext.broadcast(books[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, sums = MeanOrder(held.value), Sums(*held.value.shape)
            for batch in batches:
                x = matrix(batch.column(0), width)
                sums.add(x, order.nearest(x)[0])
            yield sums_batch(list(sums.rows(0)))

        return run

    for _ in range(rounds):
        centroids = moved(centroids[None], kept.select("x"), add_up)[0]
    last = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = MeanOrder(last.value)
        for batch in batches:
            number, distance = order.nearest(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    schema = kept.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    assigned = written(kept.select("vec_id", "x").mapInArrow(assign, schema), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()
    inertia = sum(int(r["s"]) for r in sums)
    facts = spark.createDataFrame(
        [(r["cluster"], int(r["s"]), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
         for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row per centroid
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
