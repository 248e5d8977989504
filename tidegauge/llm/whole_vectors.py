"""Vectors of whole numbers, and codebooks of them that move to the means of their members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components beyond this are refused: squared distances of 64 of them would no longer fit a long.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components; true for the empty vector."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as whole numbers; an error beyond :data:`LARGEST`."""
    def whole(x: Column) -> Column:
        raised = F.floor(x * scale)
        fits = F.abs(x) <= LARGEST / scale
        return F.when(fits, raised.cast("int")).otherwise(
            F.raise_error(F.lit(f"component beyond +-{LARGEST // scale}: squared distances would not fit")).cast("int")
        )

    return F.transform(vector.cast("array<double>"), whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


class Sums:
    """Members and componentwise sums per entry of a codebook, exact, for one task's rows."""

    def __init__(self, entries: int, width: int):
        self.count = np.zeros(entries, np.int64)
        self.total = np.zeros((entries, width), np.int64)

    def add(self, x: np.ndarray, entry: np.ndarray) -> None:
        order = np.argsort(entry, kind="stable")
        used, first = np.unique(entry[order], return_index=True)
        if used.size:
            self.total[used] += np.add.reduceat(x[order], first, axis=0)
            self.count += np.bincount(entry, minlength=self.count.size)

    def rows(self, book: int) -> Iterator[tuple[int, int, int, list[int]]]:
        for e in np.flatnonzero(self.count):
            yield book, int(e), int(self.count[e]), self.total[e].tolist()


SUMS = "book int, entry int, n long, total array<long>"


def sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["book", "entry", "n", "total"]
    )


def moved(books: np.ndarray, vectors: DataFrame, add_up: Callable[[np.ndarray], Callable]) -> np.ndarray:
    """``books[book, entry]`` with every used entry at the floored mean of its members.

    ``add_up(books)`` makes the function for ``mapInArrow`` that gives each
    task's :data:`SUMS`. They are added per entry and component before they
    reach the driver, so it gets one number per component of the books.
    """
    per_task = vectors.mapInArrow(add_up(books), SUMS)
    long = per_task.select("book", "entry", "n", F.posexplode("total").alias("place", "part"))
    # as decimals, so that no sum can overflow unnoticed
    totals = long.groupBy("book", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(19,0)")).alias("total")
    )
    out = books.copy()
    for book, entry, place, n, total in totals.collect():
        out[book, entry, place] = int(total) // n
    return out
