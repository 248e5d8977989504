"""Buckets, ticks, history, warm-up, epochs and the adjustment gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.moments import zero_filled
from tidegauge.operators.ordering import with_previous
from tidegauge.schemas import Params, total_columns


def bucket_start(ts: str, seconds: int) -> Column:
    """Start of the tumbling bucket that holds ``ts``."""
    return F.window(ts, f"{seconds} seconds")["start"]


def tumbling_bucket(df: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    return df.withColumn("bucket", bucket_start(ts, seconds))


def report_duration(reports: DataFrame, start: Column, keys: Sequence[str] = ("job", "task")) -> DataFrame:
    """Milliseconds since the previous report of the task, the first from ``start``."""
    order = ["ts"]
    since = with_previous(reports, list(keys), order, "ts", "_before")
    elapsed = F.unix_millis("ts") - F.unix_millis(F.coalesce("_before", start))
    return since.withColumn("duration_ms", elapsed).drop("_before")


def optimise_tick(ts: Column, start: Column, interval_seconds: int) -> Column:
    """Tick that consumes a report; the first tick covers two intervals."""
    span = interval_seconds * 1_000_000
    return F.greatest(F.lit(1), F.floor((F.unix_micros(ts) - F.unix_micros(start)) / span)).cast("int")


def with_tick(reports: DataFrame, params: Params, ts: str = "ts") -> DataFrame:
    """Add the tick of each report, counted from ``params.start`` or the job's first report."""
    if params.start is not None:
        start = F.lit(params.start).cast("timestamp")
        return reports.withColumn("tick", optimise_tick(F.col(ts), start, params.interval_seconds))
    first = reports.groupBy("job").agg(F.min(ts).alias("_start"))
    return (
        reports.join(first, "job")
        .withColumn("tick", optimise_tick(F.col(ts), F.col("_start"), params.interval_seconds))
        .drop("_start")
    )


def allocation_as_of(snapshots: DataFrame, ends: DataFrame) -> DataFrame:
    """The allocation at every tick up to ``_last`` of ``ends(job, _last)``: that of the last snapshot at or before it.

    ``snapshots`` has all components of a job at the ticks that have one. Ticks
    before a job's first snapshot have no allocation.
    """
    ticks = snapshots.select("job", "tick").distinct().join(ends, "job").filter(F.col("tick") <= F.col("_last"))
    following = F.lead("tick").over(Window.partitionBy("job").orderBy("tick"))
    spans = ticks.withColumn("_until", F.coalesce(following - 1, F.col("_last"))).drop("_last")
    return snapshots.join(spans, ["job", "tick"]).withColumn(
        "tick", F.explode(F.sequence(F.greatest("tick", F.lit(1)), F.greatest("_until", F.lit(1))))
    ).drop("_until")


def last_ticks(totals: DataFrame) -> DataFrame:
    return totals.groupBy("job").agg(F.max("tick").alias("_last"))


def allocation_spans(snapshots: DataFrame) -> DataFrame:
    """The stretches of constant allocation: ``(job, epoch, start, until, component, kind, executors)``.

    Only changes make rows, however many snapshots there are. ``until`` is NULL
    in the stretch that still lasts; ``start`` of the first one is its snapshot.
    """
    whole = snapshots.groupBy("job", "tick").agg(
        F.array_sort(F.collect_list(F.struct("component", "kind", "executors"))).alias("_state")
    )
    by_tick = Window.partitionBy("job").orderBy("tick")
    before = F.lag("_state").over(by_tick)
    starts = whole.withColumn("_new", before.isNull() | (before != F.col("_state"))).filter("_new")
    spans = starts.select(
        "job", (F.row_number().over(by_tick) - 1).alias("epoch"), F.greatest("tick", F.lit(1)).alias("start"),
        (F.lead("tick").over(by_tick) - 1).alias("until"), "_state",
    )
    # in a step of its own: a window beside an explode would see the exploded rows
    return spans.select("job", "epoch", "start", "until", F.explode("_state").alias("_one")).select(
        "job", "epoch", "start", "until", "_one.*"
    )


def continued_spans(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Known ``spans`` and later ``snapshots`` as spans again; the first one known of a job keeps its number."""
    base = spans.groupBy("job").agg(F.min("epoch").alias("_base"))
    known = spans.select("job", F.col("start").alias("tick"), "component", "kind", "executors")
    again = allocation_spans(known.unionByName(snapshots.select(*known.columns)))
    return again.join(base, "job", "left").withColumn("epoch", F.col("epoch") + F.coalesce("_base", F.lit(0))).drop("_base")


def _ends(totals: DataFrame, reach: DataFrame | None) -> DataFrame:
    ends = last_ticks(totals)
    return ends.withColumn("_first", F.lit(1)) if reach is None else ends.join(reach, "job")


def _filled(frame: DataFrame, totals: DataFrame) -> DataFrame:
    return zero_filled(frame.join(totals.drop("kind"), ["job", "component", "tick"], "left"))


def dense_ticks(totals: DataFrame, allocation: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """One row per tick for every component of the job, zero where nothing came in.

    Adds ``executors`` from the constant ``allocation``. ``reach(job, _first)``
    leaves out earlier ticks. ``totals`` is small (one row per component and
    tick) and read twice, so hand in a written table when it comes from a large
    scan.
    """
    frame = allocation.join(_ends(totals, reach), "job").withColumn(
        "tick", F.explode(F.sequence(F.greatest("_first", F.lit(1)), "_last"))
    )
    return _filled(frame.drop("_first", "_last"), totals)


def dense_epochs(totals: DataFrame, snapshots: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """:func:`dense_ticks` for an allocation that changes, with ``epoch`` and ``tick_in_epoch``.

    At each tick the last snapshot at or before it holds. The tick that sees a
    change is left out; the ticks after it count from one.
    """
    return dense_spans(totals, allocation_spans(snapshots), reach)


def dense_spans(totals: DataFrame, spans: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """:func:`dense_epochs` from the spans of the snapshots; spans that no wanted tick lies in may be missing."""
    spans = spans.join(_ends(totals, reach), "job")
    low = F.greatest(F.col("start") + (F.col("epoch") > 0).cast("int"), F.col("_first"))
    high = F.least(F.coalesce("until", "_last"), F.col("_last"))
    frame = (
        spans.withColumn("_low", low).withColumn("_high", high).filter(F.col("_low") <= F.col("_high"))
        .withColumn("tick", F.explode(F.sequence("_low", "_high")))
        .withColumn("tick_in_epoch", F.col("tick") - F.col("start") + (F.col("epoch") == 0).cast("int"))
        .drop("start", "until", "_first", "_last", "_low", "_high")
    )
    return _filled(frame, totals)


def unallocated_totals(totals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Totals that no allocation holds for, and which so have no part in :func:`dense_epochs`.

    These are totals of ticks before the job's first snapshot, of a component
    that the snapshot in force lacks, and of a job without any.
    """
    spans = allocation_spans(snapshots).select("job", "component", "start", F.coalesce("until", F.lit(2**31 - 1)).alias("until"))
    held = (
        (totals["job"] == spans["job"]) & (totals["component"] == spans["component"])
        & totals["tick"].between(spans["start"], spans["until"])
    )
    return totals.join(spans, held, "left_anti")


def allocation_epochs(allocation: DataFrame) -> DataFrame:
    """Number the stretches of constant allocation.

    ``allocation`` has one row per job, tick and component, without gaps (see
    :func:`allocation_as_of`). Result per job and tick: ``epoch``, whether the tick is the one that saw the change (its data
    is discarded), and ``tick_in_epoch`` counted over the kept ticks.
    """
    whole = allocation.groupBy("job", "tick").agg(
        F.array_sort(F.collect_list(F.struct("component", "executors"))).alias("_state")
    )
    by_tick = Window.partitionBy("job").orderBy("tick")
    before = F.lag("_state").over(by_tick)
    flagged = whole.select(
        "job", "tick", (before.isNotNull() & (before != F.col("_state"))).alias("changed")
    )
    numbered = flagged.withColumn("epoch", F.sum(F.col("changed").cast("int")).over(by_tick).cast("int"))
    kept = F.sum((~F.col("changed")).cast("int")).over(Window.partitionBy("job", "epoch").orderBy("tick"))
    return numbered.withColumn("tick_in_epoch", kept.cast("int"))


def history_rollup(
    totals: DataFrame, history_size: int, keys: Sequence[str] = ("job", "component"), columns: Sequence[str] = ()
) -> DataFrame:
    """Totals of the last ``history_size`` ticks.

    The frame is a range over tick numbers: an empty tick takes its place too.
    """
    added = list(columns) or [c for c in total_columns() if c in totals.columns]
    w = Window.partitionBy(*keys).orderBy("tick").rangeBetween(-(history_size - 1), 0)
    rest = [c for c in totals.columns if c not in added]
    return totals.select(*rest, *[F.sum(c).over(w).alias(c) for c in added])


def history_window(df: DataFrame, history_size: int, keys: Sequence[str], tick: str = "tick") -> DataFrame:
    """First tick, and number of ticks with rows, in the history of each row."""
    w = Window.partitionBy(*keys).orderBy(tick).rangeBetween(-(history_size - 1), 0)
    return df.select("*", F.min(tick).over(w).alias("oldest_tick"), F.count(F.lit(1)).over(w).alias("ticks_held"))


def warmup_gate(df: DataFrame, params: Params, tick_in_epoch: str = "tick_in_epoch") -> DataFrame:
    """Rows from the tick on at which the history counts as filled."""
    return df.filter(F.lit(params.history_ignore) + F.col(tick_in_epoch) >= params.history_size)


def adjust_gate(df: DataFrame, params: Params, tick: str = "tick") -> DataFrame:
    """Rows of ticks late enough for an adjustment.

    Tick ``t`` fires ``(t + 1)`` intervals after the start.
    """
    elapsed = (F.col(tick).cast("bigint") + 1) * (params.interval_seconds * 1000)
    return df.filter(elapsed >= params.adjust_min * 1000 - 50)
