"""Small helpers around DataFrames that every operator here uses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_column(df: DataFrame, source: str, makes: str, per_batch: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Replace column ``source`` by the columns of the schema text ``makes``.

    ``per_batch`` gets the column of one Arrow batch and returns one array per
    new column. All other columns pass through; a clash of names with ``makes``
    is the caller's to avoid.
    """
    keep = [c for c in df.columns if c != source]
    passed = df.select(*keep).schema
    for field in df.sparkSession.createDataFrame([], makes).schema.fields:
        passed = passed.add(field)
    names = passed.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = per_batch(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    return df.select(*keep, source).mapInArrow(run, passed)


def keep_rows(df: DataFrame, column: str, wanted: Callable[[pa.Array], pa.Array], rows: int = 256) -> DataFrame:
    """Rows for which ``wanted`` is true, over ``column`` of ``rows`` rows of a batch at a time; all columns as they are."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wanted(batch.column(place).slice(i, rows)) for i in range(0, batch.num_rows, rows)]
            if found:
                yield batch.filter(pa.concat_arrays(found))

    return df.mapInArrow(run, df.schema)


def spread_count(rows: int, each: int) -> int:
    """Partitions so that each holds about ``each`` of ``rows``."""
    return max(1, -(-rows // each))


def skipped(remainder_of: int, *remainders: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves one of ``remainders``; a null id counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (crc % remainder_of).isin(*remainders)
