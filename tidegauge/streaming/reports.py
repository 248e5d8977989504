"""The live tick from what tasks report: log lines and allocation snapshots as streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators import moments, points, timeline, topology
from tidegauge.schemas import MODEL_QUEUES, Params, total_columns
from tidegauge.streaming.live import States, each_batch, recommend, with_earlier

SNAPSHOT = ("job", "tick", "component", "kind", "executors")
SPANS = "job string, epoch int, start int, until int, component string, kind string, executors int"


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of a log folder that is split by job, as they are added to it."""
    reader = spark.readStream.schema("value string, job string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def _interval(params: Params):
    """The window of a report: intervals are counted from the start of the optimiser."""
    if params.start is None:
        raise ValueError("a live tick needs params.start")
    begun = datetime.datetime.fromisoformat(params.start).replace(tzinfo=datetime.timezone.utc)
    span = f"{params.interval_seconds} seconds"
    return F.window("ts", span, span, f"{int(begun.timestamp()) % params.interval_seconds} seconds")


def once(measured: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports as they come, a report that is sent again within ``late`` left out."""
    return measured.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "component", "task", "ts"])


def unknown_reports(measured: DataFrame, executors: DataFrame) -> DataFrame:
    """The live reject stream: reports of tasks that no executor has."""
    return topology.unknown_tasks(measured, executors)


def closed_totals(measured: DataFrame, executors: DataFrame, params: Params, late: str = "1 hour") -> DataFrame:
    """Component totals of every closed interval, from one report per task; live twin of ``totals_of_reports``.

    ``executors`` is a table, joined to the stream. An interval comes out once
    the watermark has passed its end.
    """
    placed = topology.tasks_to_executors(once(measured, late), executors)
    first = F.col("task") == F.col("executor")
    queue = [F.when(first, F.col(c)).alias(c) for c in ("duration_ms", *MODEL_QUEUES)]
    flat = points.report_totals(placed).select("job", "ts", "component", "kind", "cnt", "s", "ss", *queue)
    per_interval = moments.component_totals(flat.withColumn("tick", _interval(params)))
    begun = F.lit(params.start).cast("timestamp")
    return per_interval.withColumn("tick", timeline.optimise_tick(F.col("tick.start"), begun, params.interval_seconds))


def stream_tick(
    totals: DataFrame, snapshots: DataFrame, params: Params, folder: str, late: str = "1 hour"
) -> StreamingQuery:
    """Recommend, decide and record after every closed tick, with the allocation as a second stream.

    ``totals`` streams :func:`closed_totals`, ``snapshots`` has ``ts`` and the
    columns of :data:`SNAPSHOT`, all components of a job at a tick. Both carry
    a watermark, and the smaller one counts: a tick comes out only when every
    snapshot up to its end is known.

    State is versioned by batch and bounded: the spans of constant allocation
    that the history of later ticks can reach, with the numbers they have in
    the whole stream, and the snapshots of ticks that have not closed yet.
    """
    spark, columns = totals.sparkSession, total_columns()
    keys = ["job", "tick", "component", "kind"]
    nothing = [F.lit(None).cast(T.IntegerType()).alias("executors"), F.lit(False).alias("snapshot")]
    seen = snapshots.withWatermark("ts", late).select(
        *keys, *[F.lit(None).cast(totals.schema[c].dataType).alias(c) for c in columns],
        F.col("executors").cast("int").alias("executors"), F.lit(True).alias("snapshot"),
    )
    both = totals.select(*keys, *columns, *nothing).unionByName(seen)
    schema = both.schema

    def work(batch: DataFrame, batch_id: int) -> None:
        arrived = States(spark, f"{folder}/arrived", schema).save(batch, batch_id)
        if arrived.isEmpty():
            return
        waiting = States(spark, f"{folder}/waiting", both.select(*SNAPSHOT).schema)
        held = States(spark, f"{folder}/spans", T.StructType.fromDDL(SPANS))
        fresh = arrived.filter("NOT snapshot").select(*keys, *columns)
        # a job without a name only moves the watermark: see live.close
        known = waiting.before(batch_id).unionByName(arrived.filter("snapshot AND job <> ''").select(*SNAPSHOT))
        oldest, closed = fresh.agg(F.min("tick"), F.max("tick")).first()
        if closed is None:
            waiting.save(known, batch_id)
            held.save(held.before(batch_id), batch_id)
            return
        reachable = F.col("until").isNull() | (F.col("until") >= oldest - params.history_size)
        spans = timeline.continued_spans(held.before(batch_id).filter(reachable), known.filter(F.col("tick") <= closed))
        saved = held.save(spans.select(*T.StructType.fromDDL(SPANS).names), batch_id)
        waiting.save(known.filter(F.col("tick") > closed), batch_id)
        merged, due = with_earlier(States(spark, f"{folder}/ticks", fresh.schema), fresh, batch_id, params)
        recommend(merged, saved, params, due, folder, batch_id)

    return each_batch(both, work, f"{folder}/checkpoint")
