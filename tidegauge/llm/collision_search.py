"""Nearest neighbours by collision counting (query-aware hashing).

Every vector is projected on ``lines`` random directions, and each direction
keeps its values as a sorted array. A query collides with a vector on a line if
the vector's value lies in a window centred on the query's. Windows widen by
virtual rehashing: no second index, the same arrays are read at twice the width
until enough is found. Vectors that collide on at least ``least`` of the lines
are verified with their exact cosine.

Rows are dealt into blocks, each with its own arrays, and the query set meets
each block in bounded chunks; what a block finds for a query is its nearest few.
Equal vectors are one point, so copies, however many, are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.frames import spread_count
from tidegauge.session import written

LINES = 48
LEAST = 0.65
WIDTH = 1.4
GROW = 1.12
#: Further apart than any two projections, so that all lines lie in one sorted array.
APART = 1e6
#: Vectors verified per query and block, as a multiple of the neighbours wanted, before widening stops.
ENOUGH = 180
BLOCK = 4096
QUERIES_PER_UNIT = 8192
SEED = 11


def directions(width: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width, lines))


class Block:
    """Sorted arrays of one block of unit vectors, one per line, end to end."""

    def __init__(self, units: np.ndarray, lines: int):
        self.units = units
        self.along = directions(units.shape[1], lines)
        self.shift = np.arange(lines) * APART
        values = units @ self.along
        order = np.argsort(values, axis=0, kind="stable")
        self.values = (np.take_along_axis(values, order, axis=0) + self.shift).T.ravel()
        self.order = order.T.ravel()
        self.least = max(1, int(np.ceil(LEAST * lines)))

    def collide(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Positions whose collisions reach the threshold, the window widening until ``wanted`` do or all are read.

        A widening counts only what lies between the old window and the new one.
        """
        n = len(self.units)
        at = query @ self.along + self.shift
        counts = np.zeros(n, np.int64)
        low = high = np.searchsorted(self.values, at)
        half = WIDTH / 2
        while True:
            new_low = np.searchsorted(self.values, at - half, "left")
            new_high = np.searchsorted(self.values, at + half, "right")
            rings = [self.order[a:b] for a, b in zip([*new_low, *high], [*low, *new_high])]
            counts += np.bincount(np.concatenate(rings), minlength=n)
            low, high = new_low, new_high
            found = np.flatnonzero(counts >= self.least)
            if found.size >= min(wanted, n) or bool((high - low == n).all()):
                return found
            half *= GROW


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component to [0.5, 1): directions stay exact, squares finite."""
    if not vectors.size:
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, keep: int, lines: int
) -> pa.Table:
    """``(query, point, score)`` of the nearest ``keep`` verified points for each query, ties to the smaller id."""
    vectors, queries = scaled(vectors), scaled(queries)
    norms = np.sqrt((vectors * vectors).sum(1))
    block = Block(vectors / norms[:, None], lines)
    out: tuple[list, list, list] = ([], [], [])
    for q, vector in zip(query_ids, queries):
        length = np.sqrt((vector * vector).sum())
        found = block.collide(vector / length, ENOUGH * keep)
        cosine = (vectors[found] @ vector) / (norms[found] * length)
        best = np.lexsort((ids[found], -cosine))[:keep]
        out[0].append(np.full(best.size, q))
        out[1].append(ids[found][best])
        out[2].append(cosine[best])
    return pa.table([np.concatenate(x) if x else np.empty(0) for x in out], names=["query", "point", "score"]).cast(FOUND)


FOUND = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vector: str) -> Column:
    """Not null, without null, NaN or infinite components, and not zero."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)


def neighbours(
    rows: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", lines: int = LINES,
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every row whose id is divisible by ``every``.

    The score is the cosine in double precision; ties go to the smaller id, and
    the query's own row is left out. Rows with a null id, and vectors that are
    null, zero or hold null or non-finite components, take no part; vectors of
    different lengths never meet. A query with fewer than ``k`` candidates gets
    them all. If an id occurs more than once, its rows with equal vectors count
    as one. Components may be as large or as small as a double can be: a vector
    is scaled by a power of two first. Other columns play no part. An empty table gives none.
    """
    valid = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & usable("vector")
    ).distinct()
    # the k + 1 smallest ids of equal vectors: enough for any query, its own row left out
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    points = written(
        valid.withColumn("n", order).filter(F.col("n") <= k + 1).groupBy("vector")
        .agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids")),
        "points",
    )
    asked = written(
        valid.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
        .join(points.select("vector", "point"), "vector").select("query_id", "point"),
        "asked",
    )
    queries = written(
        asked.select("point").distinct().join(points.select("point", "vector"), "point")
        .select(F.col("point").alias("query"), "vector"),
        "queries",
    )
    blocks = spread_count(points.count(), block)
    slices = spread_count(asked.count(), QUERIES_PER_UNIT)
    units = ["width", "block", "slice"]
    dealt = points.select(
        "point", "vector", F.size("vector").alias("width"), F.pmod(F.xxhash64("point"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    sent = queries.select(
        "query", "vector", F.size("vector").alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int").alias("slice"),
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        return search_block(
            left.column("point").to_numpy(), _matrix(left.column("vector")),
            right.column("query").to_numpy(), _matrix(right.column("vector")), k + 1, lines,
        )

    found = dealt.groupBy(*units).cogroup(sent.groupBy(*units)).applyInArrow(search, "query long, point long, score double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))
    kept = written(found.withColumn("n", nearest).filter(F.col("n") <= k + 1).drop("n"), "found")
    members = kept.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        asked.withColumnRenamed("point", "query").join(members, "query").filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
