"""From raw tuple events to everything a task measures, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.moments import histogram_bins
from tidegauge.operators.ordering import sample_one_in_n
from tidegauge.operators.timeline import bucket_start
from tidegauge.schemas import Params


def task_measurements(events: DataFrame, params: Params, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Moments, deadline misses, histogram, failures and emits per task, stream and bucket.

    ``events`` are ``(job, ts, component, kind, task, stream, elapsed_ms, outcome)``
    plus the tie-breaking ``order`` columns. A source measures completed tuples, a
    service every execution that took time. Below a sample rate of one, only
    every N-th tuple of a task is measured.
    """
    sampled = sample_one_in_n(events, ["job", "task"], list(order), params.sample_rate)
    source = F.col("kind") == "source"
    done = F.when(source, F.col("outcome") == "ok").otherwise(F.col("elapsed_ms") > 0)
    completed = F.when(source & (F.col("outcome") == "ok"), F.col("elapsed_ms"))
    x, missed = F.col("_x"), F.col("_missed")
    threshold = params.latency_threshold_ms
    late = completed > threshold if threshold is not None else F.lit(False)
    bins = histogram_bins(F.col("_completed"), sorted(params.histogram_cuts)) if params.histogram_cuts else []
    return (
        sampled.select(
            "job", "component", "kind", "task", "stream",
            bucket_start("ts", params.bucket_seconds).alias("bucket"),
            F.when(done, F.col("elapsed_ms")).alias("_x"),
            completed.alias("_completed"),
            F.when(late, completed).alias("_missed"),
            (source & (F.col("outcome") == "fail")).alias("_failed"),
        )
        .groupBy("job", "bucket", "component", "kind", "task", "stream")
        .agg(
            F.count(F.lit(1)).alias("emitted"),
            F.count(x).alias("cnt"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(x * x), F.lit(0.0)).alias("ss"),
            F.count(missed).alias("miss_cnt"), F.coalesce(F.sum(missed), F.lit(0.0)).alias("miss_s"),
            F.coalesce(F.sum(missed * missed), F.lit(0.0)).alias("miss_ss"),
            F.count_if("_failed").alias("fails"),
            *bins,
        )
    )
