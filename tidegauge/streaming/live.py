"""Live variants: the same aggregations over a stream, and the live tick."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.moments import cmv_aggregate
from tidegauge.operators.ordering import one_in_n, with_position
from tidegauge.plans.optimise import (
    CHANGE_SCHEMA, RESULT_SCHEMA, alloc_record, decide, due_history, history_context, optimise_history, rebalance_plan,
)
from tidegauge.schemas import CMV, Params, total_columns
from tidegauge.session import fresh_path, written
from tidegauge.streaming.counters import CounterLog

# Later than any event.
FAR = "9000-01-01 00:00:00"


def stream_cmv(
    events: DataFrame, keys: Sequence[str], value: str, bucket_seconds: int, late: str = "1 hour"
) -> DataFrame:
    """Moments per tumbling bucket; a bucket comes out once it is closed.

    Rows later than ``late`` are dropped and counted in the query progress.
    """
    bucketed = events.withWatermark("ts", late)
    window = F.window("ts", f"{bucket_seconds} seconds")
    return cmv_aggregate(bucketed, [window, *keys], value).select(
        F.col("window.start").alias("bucket"), F.col("window.end").alias("bucket_end"), *keys, "cnt", "s", "ss"
    )


def stream_history(
    events: DataFrame, keys: Sequence[str], value: str, interval_seconds: int, history_size: int, late: str = "1 hour"
) -> DataFrame:
    """Moments over the last ticks, as a sliding window of ``history_size`` intervals.

    Rows are first added up per interval; only those few sums enter the
    overlapping windows, not every event ``history_size`` times.
    """
    interval = F.window("ts", f"{interval_seconds} seconds")
    ticks = cmv_aggregate(events.withWatermark("ts", late), [interval, *keys], value)
    window = F.window(
        F.window_time("window"), f"{interval_seconds * history_size} seconds", f"{interval_seconds} seconds"
    )
    return ticks.groupBy(window.alias("history"), *keys).agg(*[F.sum(c).alias(c) for c in CMV]).select(
        F.col("history.start").alias("history_start"), F.col("history.end").alias("history_end"), *keys, *CMV
    )


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything available now, into a parquet folder."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def closable(events: DataFrame, folder: str) -> DataFrame:
    """``events`` with a second source, in which :func:`close` puts one row when a finite input is over."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("overwrite").parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def close(spark: SparkSession, schema: T.StructType, folder: str, ts: str = "ts") -> None:
    """Move the watermark past every open interval: the next run of the stream gives the last ones.

    The row lies in the year 9000, in an interval of its own that never closes.
    It has no NULL, so that no filter below the watermark takes it away.
    """
    kinds = {"string": "''", "timestamp": f"TIMESTAMP '{FAR}'", "timestamp_ntz": f"TIMESTAMP_NTZ '{FAR}'"}

    def value(kind: T.DataType) -> str:
        return "map()" if isinstance(kind, T.MapType) else kinds.get(kind.simpleString(), "0")

    values = [f"CAST({value(f.dataType)} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema]
    spark.range(1).selectExpr(*values).write.mode("append").parquet(folder)


def drained(spark: SparkSession, stream: DataFrame, tag: str, closing: tuple[T.StructType, str] | None = None) -> DataFrame:
    """The finished output of :func:`to_files` in a fresh folder of the shared one.

    With ``closing``, the schema and folder of :func:`closable`, also the
    intervals that were still open at the end.
    """
    base = fresh_path(spark, tag)
    to_files(stream, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    if closing:
        close(spark, *closing)
        to_files(stream, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class States:
    """One table per batch below a folder, of which only the two newest are kept.

    A repeated batch finds the table of the batch before it and writes its own
    again, whole.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        if not self.files.exists(self.path):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self.path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def before(self, batch_id: int) -> DataFrame:
        earlier = [b for b in self._batches() if b < batch_id]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={earlier[-1]}")

    def save(self, rows: DataFrame, batch_id: int) -> DataFrame:
        target = f"{self.folder}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        for old in [b for b in self._batches() if b < batch_id][:-1]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={old}"), True)
        return self.spark.read.schema(self.schema).parquet(target)


def stream_optimise(
    closed: DataFrame,
    to_totals: Callable[[DataFrame], DataFrame],
    allocation: DataFrame | Callable[[], DataFrame],
    params: Params,
    folder: str,
) -> StreamingQuery:
    """Recommend, decide and plan the change after every closed tick.

    ``closed`` streams the rows of closed intervals (see :func:`stream_cmv`);
    ``to_totals`` reduces a micro-batch of them to component totals per tick.
    ``allocation`` is constant or the snapshots so far, read anew for each batch.
    A batch keeps the totals that the history of later ticks can still reach and
    optimises the ticks it touched, so its work does not grow with the age of
    the stream; for snapshots as a stream of their own see
    :func:`~tidegauge.streaming.reports.stream_tick`. Results, changes and records are keyed by batch id and written
    whole, so a repeated batch leaves the same rows.
    """
    spark = closed.sparkSession
    columns = total_columns()
    keys = ["job", "tick", "component", "kind"]
    states: list[States] = []

    def work(batch: DataFrame, batch_id: int) -> None:
        totals = to_totals(batch).select(*keys, *columns)
        if not states:
            states.append(States(spark, f"{folder}/ticks", totals.schema))
        fresh = States(spark, f"{folder}/fresh", totals.schema).save(totals, batch_id)
        if fresh.isEmpty():
            # most micro-batches close no interval
            return
        merged, due = with_earlier(states[0], fresh, batch_id, params)
        recommend(merged, allocation() if callable(allocation) else allocation, params, due, folder, batch_id)

    return each_batch(closed, work, f"{folder}/checkpoint")


def with_earlier(state: States, fresh: DataFrame, batch_id: int, params: Params) -> tuple[DataFrame, DataFrame]:
    """The totals that the ticks of a batch and their history need, and the ticks that are due.

    What the history of later ticks can reach is saved for the next batch.
    """
    keys, columns = ["job", "tick", "component", "kind"], total_columns()
    # one tick may close in several batches: the first covers two intervals
    both = state.before(batch_id).unionByName(fresh)
    merged = written(both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns]), "live-totals")
    newest = F.max("tick").over(Window.partitionBy("job"))
    near = merged.withColumn("_newest", newest).filter(F.col("tick") > F.col("_newest") - params.history_size)
    state.save(near.drop("_newest"), batch_id)
    return merged, fresh.groupBy("job").agg(F.min("tick").alias("first_due"), F.max("tick").alias("last_due"))


def recommend(totals: DataFrame, allocation: DataFrame, params: Params, due: DataFrame, folder: str, batch_id: int) -> None:
    """Write result, changes and records of the due ticks, each under the batch's number."""
    spark = totals.sparkSession
    history = written(due_history(totals, allocation, params, due), "live-history")
    target = f"{folder}/results/batch={batch_id}"
    optimise_history(history, params).write.mode("overwrite").parquet(target)
    result = spark.read.schema(RESULT_SCHEMA).parquet(target)
    rebalance_plan(decide(result, params), params).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
    records = alloc_record(result, history_context(history, params))
    records.write.mode("overwrite").parquet(f"{folder}/records/batch={batch_id}")


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{RESULT_SCHEMA}, batch int").parquet(f"{folder}/results").groupBy("job", "tick").agg(
        F.max("batch").alias("batch")
    )


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """The allocation records, of the latest result of every job and tick."""
    records = spark.read.schema("job string, tick int, value string, batch int").parquet(f"{folder}/records")
    return records.join(_latest(spark, folder), ["job", "tick", "batch"], "left_semi").drop("batch")


def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes to make, of the latest result of every job and tick."""
    changes = spark.read.schema(f"{CHANGE_SCHEMA}, batch int").parquet(f"{folder}/changes")
    return changes.join(_latest(spark, folder), ["job", "tick", "batch"], "left_semi").drop("batch")


def stream_results(spark: SparkSession, folder: str) -> DataFrame:
    """Latest result of every job, tick, component and objective."""
    rows = spark.read.schema(f"{RESULT_SCHEMA}, batch int").parquet(f"{folder}/results")
    values = [c for c in rows.columns if c not in ("job", "tick", "component", "objective", "batch")]
    return rows.groupBy("job", "tick", "component", "objective").agg(
        F.max_by(F.struct(*values), "batch").alias("_row")
    ).select("job", "tick", "component", "objective", "_row.*")


def stream_stateful_counter(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, rate: float = 1.0
) -> StreamingQuery:
    """Number the rows of each key across micro-batches, and mark the sampled ones.

    State is one counter per key in a :class:`~tidegauge.streaming.counters.CounterLog`:
    a batch reads the buckets of its own keys and writes the counters of its own keys.
    Positions inside a batch come from slices, so one busy key does not land in
    one task. NULL keys are counted like any other. A repeated batch reads the
    same counters and leaves the same rows.
    """
    spark = rows.sparkSession
    keys, n = list(keys), one_in_n(rate)
    log = CounterLog(spark, f"{folder}/counters", rows.select(*keys).schema)

    def work(batch: DataFrame, batch_id: int) -> None:
        log.compact(batch_id)
        placed = written(with_position(batch, keys, order, "_position"), "placed")
        before = log.before(batch_id, placed.select(*keys))
        numbered = (
            placed.withColumn("_key", log.key()).join(before, "_key", "left")
            .withColumn("position", F.coalesce("_seen", F.lit(0)) + F.col("_position"))
            .withColumn("sampled", F.col("position") % n == 0)
            .drop("_seen", "_position", "_key")
        )
        target = f"{folder}/rows/batch={batch_id}"
        numbered.write.mode("overwrite").parquet(target)
        counts = spark.read.schema(numbered.schema).parquet(target).groupBy(*keys)
        log.add(counts.agg((F.max("position") + 1).alias("_seen")), batch_id)

    return each_batch(rows, work, f"{folder}/checkpoint")
