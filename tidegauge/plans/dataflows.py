"""The three example dataflows, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import dataflow as d


def dataflow_chain(records: DataFrame) -> DataFrame:
    """source -> A -> B."""
    return d.mark_words(d.forward_words(records))


def dataflow_two_path(
    records: DataFrame, p: float, taken: Callable[[Column], Column] = lambda word: word,
    other: Callable[[Column], Column] = lambda word: word,
) -> DataFrame:
    """source -> {A-P on the taken stream, A-NotP on the other} -> B.

    ``taken`` and ``other`` are what the two services do to a word, and ``path``
    tells which of them handled it. Split and merge are one column, so the
    records are read once; services that are more than a column are put between
    :func:`~tidegauge.operators.dataflow.on_stream` and ``merge_streams``.
    """
    routed = d.forward_words(d.split_stream(records, p))
    on_taken = F.col("stream") == d.TAKEN
    word = F.when(on_taken, taken(F.col("word"))).otherwise(other(F.col("word")))
    path = F.when(on_taken, F.lit("A-P")).otherwise(F.lit("A-NotP"))
    return d.mark_words(routed.withColumns({"word": word, "path": path}))


def dataflow_loop(records: DataFrame, p: float) -> DataFrame:
    """source -> A -> B, with B feeding itself."""
    return d.loop_back(d.forward_words(records), p)
