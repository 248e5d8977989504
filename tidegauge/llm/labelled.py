"""A bounded sample of labelled texts, to fit small models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import written


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, training: Column, bound: int, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """About ``bound`` rows ``(doc_id, text, y)`` of the ``training`` rows, chosen by a hash of the id.

    Null ids and labels take no part. Repeated labels of an id count by their
    mean, repeated rows of an id by the smallest text, so each id is one row
    however often it occurs. The ids that are broadcast are as few as the bound.
    """
    marked = written(
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & training)
        .groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")),
        "labelled",
    )
    share = min(1.0, bound / max(1, marked.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000))
    chosen = marked.filter(place < int(share * 1_000_000))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(
        texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")),
        "sample",
    )


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts between equally frequent ranges of each column, padded with infinity."""
    cuts = np.full((values.shape[1], bins - 1), np.inf)
    for j, column in enumerate(values.T):
        own = np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)
        cuts[j, : own.size] = own
    return cuts


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, values.T)], axis=1)
