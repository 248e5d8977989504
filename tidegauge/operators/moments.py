"""Aggregations: moments, histograms, deadlines, queues, roll-ups.

Everything here adds up, so each plan combines before its shuffle and a key
with a large share of the rows costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import moments as m
from tidegauge.operators.ordering import sample_one_in_n
from tidegauge.schemas import CMV, MODEL_QUEUES, queue_columns, total_columns


def cmv_aggregate(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """Count, sum and sum of squares of ``value`` per key; empty keys are absent."""
    x = F.col(value) if isinstance(value, str) else value
    return (
        df.withColumn("_x", x)
        .filter(F.col("_x").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.sum("_x").cast("double").alias("s"),
            F.sum(F.col("_x") * F.col("_x")).cast("double").alias("ss"),
        )
    )


def cmv_merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial moments."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CMV])


def with_cmv_stats(df: DataFrame) -> DataFrame:
    """Add ``avg, avg2, var, scv``."""
    cnt, s, ss = F.col("cnt"), F.col("s"), F.col("ss")
    return df.select(
        "*",
        m.avg(cnt, s).alias("avg"),
        m.avg2(cnt, ss).alias("avg2"),
        m.var(cnt, s, ss).alias("var"),
        m.scv(cnt, s, ss).alias("scv"),
    )


def stream_combine(df: DataFrame, keys: Sequence[str], keep_streams: bool = False) -> DataFrame:
    """Moments over all streams of a key.

    With ``keep_streams`` the rows of the single streams stay in the result,
    next to the combined row (``stream`` NULL).
    """
    if not keep_streams:
        return cmv_merge(df, keys)
    both = [[*keys, "stream"], [*keys]]
    sets = [[F.col(c) for c in one] for one in both]
    return df.groupingSets(sets, *both[0]).agg(*[F.sum(c).alias(c) for c in CMV])


def histogram_bins(value: Column, cuts: Sequence[float]) -> list[Column]:
    """One count per bin; a value equal to a cut belongs to the bin that ends there."""
    edges = [None, *cuts, None]
    bins = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value > low)
        if high is not None:
            inside = inside & (value <= high)
        bins.append(F.count_if(value.isNotNull() & inside).alias(f"bin{i}"))
    return bins


def latency_histogram(df: DataFrame, keys: Sequence[str], value: str | Column, cuts: Sequence[float]) -> DataFrame:
    """Counts per bin and key."""
    x = F.col(value) if isinstance(value, str) else value
    cuts = sorted(float(c) for c in cuts)
    return df.filter(x.isNotNull()).groupBy(*keys).agg(*histogram_bins(x, cuts))


def latency_histogram_text(
    df: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[float], failed: Column
) -> DataFrame:
    """``c0,c1,...,cn|fails`` per key; NULL text where nothing completed.

    Completions and failures are counted in the same pass.
    """
    if not cuts:
        raise ValueError("a histogram needs at least one cut")
    cuts = sorted(float(c) for c in cuts)
    done = F.when(~failed, F.col(value))
    counts = df.groupBy(*keys).agg(
        *histogram_bins(done, cuts), F.count_if(failed).alias("_fails"), F.count(done).alias("_done")
    )
    text = F.concat(
        F.concat_ws(",", *[F.col(f"bin{i}").cast("string") for i in range(len(cuts) + 1)]),
        F.lit("|"),
        F.col("_fails").cast("string"),
    )
    return counts.select(*keys, F.when(F.col("_done") > 0, text).alias("histogram"), F.col("_fails").alias("fails"))


def qos_miss(df: DataFrame, keys: Sequence[str], value: str, threshold: Column) -> DataFrame:
    """Moments of the completions strictly above their threshold."""
    return cmv_aggregate(df.filter(F.col(value) > threshold), keys, value)


def emit_count(
    df: DataFrame, keys: Sequence[str], task: Sequence[str], order: Sequence[str], rate: float,
    emits: str | None = None,
) -> DataFrame:
    """Emitted tuples per key (with the output stream), counted for sampled work only.

    ``emits`` says how many tuples a row of work emitted, one if not given; work
    that emitted none leaves no row.
    """
    sampled = sample_one_in_n(df, task, order, rate)
    number = F.lit(1) if emits is None else F.coalesce(F.col(emits), F.lit(0))
    return sampled.filter(number > 0).groupBy(*keys).agg(F.sum(number).cast("bigint").alias("emitted"))


def queue_moments() -> list[Column]:
    """Moment aggregates of every queue column."""
    parts = {"cnt": "count({c})", "s": "coalesce(sum({c}), 0D)", "ss": "coalesce(sum({c} * {c}), 0D)"}
    return [
        F.expr(f"{call.format(c=c)} AS {c}_{part}") for c in queue_columns() for part, call in parts.items()
    ]


def queue_aggregate(queues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of the four numbers of both queues; every sample weighs the same."""
    return queues.groupBy(*keys).agg(*queue_moments())


def duration_sum(queues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summed report durations in seconds."""
    return queues.groupBy(*keys).agg(
        (F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 1000.0).alias("duration_seconds")
    )


def _executor_ticks(executors: DataFrame, reports: DataFrame) -> DataFrame:
    """Every executor at every tick of its job, up to the last one that has a report."""
    last = reports.groupBy("job").agg(F.max("tick").alias("_last"))
    return executors.select("job", "component", "kind", F.col("task_start").alias("executor")).join(last, "job").withColumn(
        "tick", F.explode(F.sequence(F.lit(1), "_last"))
    ).drop("_last")


def executor_rollup(moments: DataFrame, executors: DataFrame) -> DataFrame:
    """Moments per tick, executor and stream; a silent executor has a zero row without stream at each tick.

    ``moments`` are per task.
    """
    tasks = executors.select(
        "job", "component", F.col("task_start").alias("executor"),
        F.explode(F.sequence("task_start", "task_end")).alias("task"),
    )
    per_executor = (
        moments.drop("component", "kind")
        .join(tasks, ["job", "task"])
        .groupBy("job", "component", "executor", "tick", "stream")
        .agg(*[F.sum(c).alias(c) for c in CMV])
    )
    frame = _executor_ticks(executors, moments).drop("kind")
    return frame.join(per_executor, ["job", "component", "executor", "tick"], "left").fillna(0, list(CMV))


def executor_results(reports: DataFrame, executors: DataFrame) -> DataFrame:
    """Moments over all streams, queue moments and summed duration of every executor at every tick, zero if silent.

    ``reports`` is flat, one row per executor report: ``cnt, s, ss``, queue
    numbers and ``duration_ms``.
    """
    sums = [F.sum(c).alias(c) for c in CMV] + [F.sum("duration_ms").alias("duration_ms")]
    added = reports.groupBy("job", "tick", "executor").agg(*sums, *queue_moments())
    frame = _executor_ticks(executors, reports)
    return frame.join(added, ["job", "tick", "executor"], "left").fillna(
        0, [c for c in added.columns if c not in ("job", "tick", "executor")]
    )


def component_rollup(rows: DataFrame, keys: Sequence[str] = ("job", "tick", "component", "stream")) -> DataFrame:
    """Executor (or task) moments added up to the component."""
    return cmv_merge(rows.filter(F.col("stream").isNotNull()) if "stream" in keys else rows, keys)


def component_totals(reports: DataFrame) -> DataFrame:
    """Everything the model needs per job, tick and component, in one pass.

    ``reports`` is flat, one row per report: ``cnt, s, ss`` over all streams,
    and queue numbers and ``duration_ms`` that are set only on first tasks.
    """
    sums = [F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in (*CMV, "duration_ms")]
    queues = [
        F.expr(f"{call} AS {c}_{part}") for c in MODEL_QUEUES
        for part, call in (("cnt", f"count({c})"), ("s", f"coalesce(sum({c}), 0D)"))
    ]
    return reports.groupBy("job", "tick", "component", "kind").agg(*sums, *queues)


def zero_filled(df: DataFrame) -> DataFrame:
    return df.fillna(0, [c for c in total_columns() if c in df.columns])

