"""Transforms of the example dataflows: routing, merging, marking, looping."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import uniform, uniform_open
from tidegauge.session import written

# Stream names and marks.
TAKEN = "P-Stream"
NOT_TAKEN = "NotP-Stream"
DONE_MARK = "!!"
LOOP_MARK = "!"


def split_stream(records: DataFrame, p: float, key: str = "sid", turn: int = 0) -> DataFrame:
    """Route each record to one of two streams; the same record goes the same way every time."""
    u = uniform(F.concat(F.col(key), F.lit(f":{turn}")))
    return records.withColumn("stream", F.when(u < p, F.lit(TAKEN)).otherwise(F.lit(NOT_TAKEN)))


def on_stream(records: DataFrame, stream: str) -> DataFrame:
    return records.filter(F.col("stream") == stream)


def merge_streams(*streams: DataFrame) -> DataFrame:
    """All records of all streams, duplicates kept."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    return merged


def shuffle_grouping(records: DataFrame, tasks: int) -> DataFrame:
    """Spread records evenly over the tasks of the consumer."""
    return records.repartition(tasks)


def forward_words(records: DataFrame) -> DataFrame:
    """First service: hands the sentence on as the word, unchanged."""
    return records.withColumnRenamed("sentence", "word")


def mark_words(records: DataFrame, word: str = "word") -> DataFrame:
    """Last service: appends its mark."""
    return records.withColumn(word, F.concat(word, F.lit(DONE_MARK)))


def loop_passes(key: Column, p: float) -> Column:
    """Pass on which a record leaves the loop, 1 or later.

    Each pass sends it round again with probability ``p``, so it is still inside
    after pass j with probability p^j; one uniform number decides all passes.
    """
    if not 0.0 <= p < 1.0:
        raise ValueError(f"a loop needs a probability in [0, 1): {p}")
    if p == 0.0:
        return F.lit(1)
    return (F.floor(F.ln(uniform_open(key)) / F.ln(F.lit(p))) + 1).cast("int")


def loop_back(records: DataFrame, p: float, key: str = "sid", word: str = "word") -> DataFrame:
    """Finished records: the word with one mark for every pass that sent it round."""
    looped = records.withColumn("passes", loop_passes(F.concat(F.col(key), F.lit(":loop")), p))
    return looped.withColumn(word, F.concat(word, F.expr(f"repeat('{LOOP_MARK}', passes - 1)")))


def emit(records: DataFrame, outputs: Mapping[str, tuple[Column, Column]], keep: tuple[str, ...] = ("sid",)) -> DataFrame:
    """A service with several named outputs: ``(*keep, stream, word)``, a row for each output a record is sent to.

    ``outputs`` has, per stream, when a record goes there and what is sent. A
    record may go to none, one or several; an unknown condition counts as no.
    Records are unfolded in one pass, whatever the number of outputs.
    """
    sent = [
        F.struct(F.lit(stream).alias("stream"), when.alias("sent"), word.alias("word")) for stream, (when, word) in outputs.items()
    ]
    return records.select(*keep, F.explode(F.filter(F.array(*sent), lambda o: o["sent"])).alias("_out")).select(
        *keep, "_out.stream", "_out.word"
    )


def consume(emitted: DataFrame, services: Mapping[str, Callable[[Column], Column]], word: str = "word") -> DataFrame:
    """Hand each stream to its own service, without reading the records again for every consumer.

    Streams that nobody consumes end here.
    """
    chosen = None
    for stream, service in services.items():
        mine = F.col("stream") == stream
        chosen = F.when(mine, service(F.col(word))) if chosen is None else chosen.when(mine, service(F.col(word)))
    return emitted.filter(F.col("stream").isin(*services)).withColumn(word, chosen)


def loop_through(
    records: DataFrame, service: Callable[[DataFrame, int], DataFrame], p: float, key: str = "sid"
) -> DataFrame:
    """Finished records with ``passes``, each having gone through ``service`` once per pass.

    ``service(records, j)`` does the work of pass j and keeps the columns. After
    a pass a record goes round again with probability ``p``, decided as in
    :func:`loop_passes`. Only records that are still inside are worked on; each
    pass is written once, which cuts the lineage, so as many rows are touched
    as there are passes of records.
    """
    if not 0.0 <= p < 1.0:
        raise ValueError(f"a loop needs a probability in [0, 1): {p}")
    columns, finished, j = records.columns, [], 0
    inside = records.withColumn("_u", uniform_open(F.concat(F.col(key), F.lit(":loop"))))
    while True:
        j += 1
        # a null key is not sent round: it has no number to be decided by
        done = written(service(inside, j).withColumn("_again", F.coalesce(F.col("_u") < F.lit(p**j), F.lit(False))), "pass")
        finished.append(done.filter("NOT _again").select(*columns, F.lit(j).alias("passes")))
        inside = done.filter("_again").drop("_again")
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, finished)
