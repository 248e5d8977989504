"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import datasets as d
from tidegauge.functions import moments as mf
from tidegauge.functions import queueing as q
from tidegauge.functions import text as tx
from tidegauge.operators import allocate, capacity, dataflow, moments, ordering, points, timeline, topology
from tidegauge.plans import dataflows, measure
from tidegauge.plans import optimise as plan
from tidegauge.schemas import APPROVED_NAMES, Params, queue_columns
from tidegauge.session import fresh_path, in_utc, spread, written
from tidegauge.sources import queue, readers, writers
from tidegauge.streaming import live, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL twins.
HISTORY = 5
BUDGET = 18
QOS_MS = 450.0
SAMPLE = 0.3
PATH_P = 0.6
LOOP_P = 0.2
PEEK = 100
RAW = 200
CURVE_MORE = 8
LONGEST = 9
SLICE = 200
GRID_MODELS = ("mmk", "ggk_simple", "ggk_complex")
PARAMS = Params(
    interval_seconds=d.DAY, history_size=HISTORY, start=d.START, qos_ms=QOS_MS, max_executors=BUDGET + 4,
)
LARGE = Params(
    interval_seconds=d.DAY, history_size=HISTORY, start=d.START, qos_ms=QOS_MS, max_executors=132,
)
APPROVED = (*APPROVED_NAMES, "latency-stat", "miss-qos")


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < q.UNDEFINED), c)


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six places; not-a-number and infinity become NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(_finite(c), 6).alias(name or column)


def r11(column: str | Column, name: str | None = None) -> Column:
    """Eleven places, for ratios that are short decimals and would tie at six."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(_finite(c), 11).alias(name or column)


def naive(column: str, name: str | None = None) -> Column:
    """Timestamp without zone."""
    return F.col(column).cast("timestamp_ntz").alias(name or column)


def cmv(*keys: str | Column) -> list[str | Column]:
    return [*keys, "cnt", r6("s"), r6("ss")]


# --- sources and sinks -------------------------------------------------------

def _aliases(spark: SparkSession) -> DataFrame:
    return points.approved_names(spark, APPROVED)


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return points.measured_points(d.metric_points(spark, sf), _aliases(spark))


def _with_kind(measured: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return measured.join(d.components(spark, sf), ["job", "component"])


def _report_names(measured: DataFrame) -> DataFrame:
    names = F.array_sort(F.map_keys("data"))
    return measured.select(
        "job", naive("ts"), "component", "task", F.array_join(names, ",").alias("names"),
        F.size("data").alias("n_values"),
    )


@query("scan_metric_points")
def scan_metric_points(spark, sf):
    path = fresh_path(spark, "points")
    d.metric_points(spark, sf).write.parquet(path)
    return _report_names(readers.scan_metric_points(spark, path, _aliases(spark)))


def _log_folder(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "log")
    writers.sink_metric_log(writers.report_lines(_measured(spark, sf)), path)
    return path


@query("scan_metric_log")
def scan_metric_log(spark, sf):
    measured, _, _ = readers.scan_metric_log(spark, _log_folder(spark, sf))
    rows = points.parse_cmv(_with_kind(measured, spark, sf))
    return rows.select(*cmv("job", naive("ts"), "component", "task", "stream"))


@query("unknown_tasks")
def unknown_tasks(spark, sf):
    """Recorded reports of tasks that no executor has: here the last two tasks of each component."""
    measured, _, _ = readers.scan_metric_log(spark, _log_folder(spark, sf))
    execs = written(d.executors(spark, sf).filter(F.col("task_start") % 8 < 6), "executors")
    _, unknown = plan.totals_of_reports(measured, execs, PARAMS)
    return unknown.select("job", naive("ts"), "component", "task", F.size("data").alias("n_values"))


def _mixed_log(spark: SparkSession, sf: str) -> str:
    """A log with task records, other records and broken lines, of jobs whose names look like numbers."""
    path = fresh_path(spark, "mixed-log")
    days = d.task_days(spark, sf).groupBy("job", "component", "task").agg(F.sum("arrivals").alias("n"))
    job = F.concat(F.lit("00"), F.substring("job", 4, 1))
    name = F.concat_ws(".", F.lit("task"), "component", F.col("task").cast("string"))
    lines = F.array(
        F.concat(name, F.lit('->{"emit":{"s0":'), F.col("n").cast("string"), F.lit('},"timestamp":1704067200000}')),
        F.concat(F.lit("topology.info->"), F.to_json(F.struct("component"))),
        F.concat(F.lit("alloc->n="), F.col("n").cast("string")),
        F.concat(F.lit("task."), "component", F.lit(".99999999999->{}")),
        F.concat(name, F.lit("->not json")), F.concat(F.lit("no arrow "), "component"),
        F.concat(name, F.lit('->{"timestamp":9999999999999999}')),
    )
    writers.sink_metric_log(days.select(job.alias("job"), F.explode(lines).alias("value")), path)
    return path


@query("scan_other_records")
def scan_other_records(spark, sf):
    _, others, _ = readers.scan_metric_log(spark, _mixed_log(spark, sf))
    return others.groupBy("job", "name", "body").agg(F.count(F.lit(1)).alias("n"))


@query("scan_rejects")
def scan_rejects(spark, sf):
    _, _, rejects = readers.scan_metric_log(spark, _mixed_log(spark, sf))
    return rejects.groupBy("job", "value").agg(F.count(F.lit(1)).alias("n"))


@query("sink_metric_log")
def sink_metric_log(spark, sf):
    lines = readers.read_metric_log(spark, _log_folder(spark, sf))
    name = F.substring_index("value", "->", 1).alias("record")
    return lines.select(F.col("job").cast("string").alias("job"), name).groupBy("job", "record").agg(
        F.count(F.lit(1)).alias("lines")
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return d.text_records(spark, sf).select(
        "conv_id", "turn", F.posexplode(F.split("sentence", "\n")).alias("line", "value")
    )


@query("scan_text_queue")
def scan_text_queue(spark, sf):
    folder = fresh_path(spark, "queue")
    _lines(spark, sf).select("value").write.text(folder)
    read = live.drained(spark, readers.scan_text_queue(spark, folder), "queue-read")
    return read.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("consume_text_queue")
def consume_text_queue(spark, sf):
    """What was taken out of the queue, what the archive holds of it, and what is left in the queue."""
    base = fresh_path(spark, "queue-taken")
    _lines(spark, sf).select("value").repartition(4).write.text(f"{base}/in")
    taken = queue.take_all(spark, f"{base}/in", f"{base}/rows", f"{base}/checkpoint", "archive", f"{base}/read", 1)
    archived = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(f"{base}/read")
    left = spark.read.option("lineSep", "\n").text(f"{base}/in")
    places = [taken.select("text", F.lit("n").alias("place"))]
    places += [x.select(F.col("value").alias("text"), F.lit(p).alias("place")) for x, p in ((archived, "n_archived"), (left, "n_left"))]
    count = [F.count_if(F.col("place") == p).alias(p) for p in ("n", "n_archived", "n_left")]
    return places[0].unionByName(places[1]).unionByName(places[2]).groupBy("text").agg(*count)


@query("scan_peek")
def scan_peek(spark, sf):
    return readers.scan_peek(_lines(spark, sf), ["conv_id", "turn", "line"], PEEK)


@query("sink_raw_lines")
def sink_raw_lines(spark, sf):
    path = fresh_path(spark, "raw")
    writers.sink_raw_lines(_lines(spark, sf), path, ["conv_id", "turn", "line"], RAW)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("scan_cluster_snapshot")
def scan_cluster_snapshot(spark, sf):
    path = fresh_path(spark, "snapshot")
    d.executors(spark, sf).write.json(path)
    return readers.scan_cluster_snapshot(spark, path, "json")


# --- points ------------------------------------------------------------------

@query("parse_approved_names")
def parse_approved_names(spark, sf):
    name = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    alias = F.concat(F.lit("  "), F.lit("as"), F.col("user_id").cast("string"), F.lit("\tignored "))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), name)).when(
        F.col("event_id") % 3 == 1, F.concat(name, alias)
    ).otherwise(F.lit("   "))
    lines = d.table(spark, sf, "events").select(line.alias("line"), F.col("event_id").alias("position"))
    return points.parse_approved_names(lines)


def _point_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job", "component", "name").agg(F.count(F.lit(1)).alias("points"))


@query("approved_metrics")
def approved_metrics(spark, sf):
    return _point_counts(points.approved_metrics(d.metric_points(spark, sf), _aliases(spark)))


@query("drop_system_components")
def drop_system_components(spark, sf):
    return _point_counts(points.drop_system_components(d.metric_points(spark, sf)))


@query("drop_empty_points")
def drop_empty_points(spark, sf):
    return _point_counts(points.drop_empty_points(d.metric_points(spark, sf)))


@query("pivot_points")
def pivot_points(spark, sf):
    return _report_names(_measured(spark, sf))


@query("parse_cmv")
def parse_cmv(spark, sf):
    rows = points.parse_cmv(_with_kind(_measured(spark, sf), spark, sf))
    return rows.select(*cmv("job", naive("ts"), "component", "task", "stream"))


@query("queue_fields")
def queue_fields(spark, sf):
    rows = points.queue_fields(_measured(spark, sf))
    return rows.select("job", naive("ts"), "component", "task", "duration_ms", *[r6(c) for c in queue_columns()])


@query("sample_one_in_n")
def sample_one_in_n(spark, sf):
    events = d.tuple_events(spark, sf).select("job", "task", "ts", "event_id")
    kept = ordering.sample_one_in_n(events, ["job", "task"], ["ts", "event_id"], SAMPLE)
    return kept.select("job", "task", naive("ts"), "event_id")


@query("service_key")
def service_key(spark, sf):
    # a service's measurement goes under the component and stream that its tuple came from
    events = d.tuple_events(spark, sf).filter(F.col("kind") != "source")
    upstream = F.lit(None).cast("string")
    for name, target in d.SUCCESSOR.items():
        upstream = F.when(F.col("component") == target, F.lit(name)).otherwise(upstream)
    elapsed_ns = (F.col("elapsed_ms") * 1e6).cast("bigint")
    keyed = events.withColumn("elapsed_ns", elapsed_ns).filter("elapsed_ns > 0").select(
        "job", "component", tx.service_key(upstream, F.col("stream")).alias("key"),
        (F.col("elapsed_ns") / 1e6).alias("ms"),
    )
    return moments.cmv_aggregate(keyed, ["job", "component", "key"], "ms").select(*cmv("job", "component", "key"))


@query("positions_in_slices")
def positions_in_slices(spark, sf):
    """A hot key and an order by text, in slices far shorter than the key's rows."""
    rows = d.table(spark, sf, "events").select("event_id", "event_type", "props")
    return ordering.with_position(rows, ["event_type"], ["props", "event_id"], each=SLICE).select("event_id", "event_type", "position")


@query("assign_sequence_id")
def assign_sequence_id(spark, sf):
    records = d.text_records(spark, sf).withColumn("task", (F.col("conv_id") % 8).cast("int")).drop("sid")
    return ordering.assign_sequence_id(records, "s", "task", ["conv_id", "turn"]).select(
        "sid", "task", "conv_id", "turn", "sentence"
    )


@query("tag_lines")
def tag_lines(spark, sf):
    return d.text_records(spark, sf).select(
        "sid", tx.tag_line("+", F.col("sentence")).alias("added"), tx.tag_line("-", F.col("sentence")).alias("removed")
    )


@query("stamp_lines")
def stamp_lines(spark, sf):
    events = d.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "props")
    placed = ordering.with_position(events, [], ["ts", "event_id"])
    return placed.select("event_id", tx.stamp_line(F.col("position"), F.col("ts"), F.col("props")).alias("value"))


@query("mark_words")
def mark_words(spark, sf):
    records = d.text_records(spark, sf).select("sid", "sentence")
    return dataflow.mark_words(dataflow.forward_words(records))


@query("job_name_from_id")
def job_name_from_id(spark, sf):
    job_id = F.concat_ws("-", "job", "component", F.unix_millis("ts").cast("string"))
    return d.tuple_events(spark, sf).select(
        "event_id", job_id.alias("job_id"), tx.job_name_from_id(job_id).alias("job_name")
    )


@query("cmv_format")
def cmv_format(spark, sf):
    rows = moments.cmv_aggregate(d.tuple_events(spark, sf), ["job", "component"], "elapsed_ms")
    cnt, s, ss = F.col("cnt"), F.col("s"), F.col("ss")
    return rows.select(
        "job", "component", mf.cmv_format(cnt, s, ss).alias("long_form"),
        mf.cmv_format_short(cnt, s, ss).alias("short_form"),
    )


# --- joins and metadata ------------------------------------------------------

@query("tasks_to_executors")
def tasks_to_executors(spark, sf):
    # the last two tasks of each component have no executor here, so they are rejects
    reports = written(d.task_moments(spark, sf), "moments")
    execs = d.executors(spark, sf).filter(F.col("task_start") % 8 < 6)
    columns = ["job", "tick", "component", "task", "stream", "cnt"]
    placed = topology.tasks_to_executors(reports, execs).select(*columns, "executor")
    rejects = topology.unknown_tasks(reports, execs).select(*columns, F.lit(None).cast("int").alias("executor"))
    return placed.unionByName(rejects)


@query("first_task_only")
def first_task_only(spark, sf):
    days = written(d.task_days(spark, sf), "task-days")
    kept = topology.first_task_only(d.moments_of_days(days), d.executors_of_days(days))
    return kept.select(*cmv("job", "tick", "component", "task", "stream"))


@query("split_by_kind")
def split_by_kind(spark, sf):
    reports = written(d.task_moments(spark, sf).drop("kind"), "moments")
    sources, services = topology.split_by_kind(reports, d.components(spark, sf))
    both = sources.withColumn("side", F.lit("source")).unionByName(services.withColumn("side", F.lit("service")))
    return moments.cmv_merge(both, ["job", "component", "side"]).select(*cmv("job", "component", "side"))


@query("with_allocation")
def with_allocation(spark, sf):
    rows = topology.with_allocation(*d.totals_and_allocation(spark, sf))
    return rows.select(*cmv("job", "tick", "component", "executors"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    totals, allocation = d.totals_and_allocation(spark, sf)
    return plan.ready_history(written(totals, "totals"), allocation, PARAMS)


def _sources(history: DataFrame) -> DataFrame:
    return topology.pick_source(capacity.source_nodes(history, PARAMS), plan.SCOPE)


def _services(spark: SparkSession, sf: str) -> DataFrame:
    """Service nodes per tick from a five-tick history, spread for per-node work."""
    return spread(capacity.network_nodes(_history(spark, sf), PARAMS), *plan.SCOPE)


@query("attach_source_rate")
def attach_source_rate(spark, sf):
    history = _history(spark, sf)
    services = history.filter(F.col("kind") == "service").select("job", "tick", "component")
    return capacity.attach_source_rate(services, _sources(history)).select(
        "job", "tick", "component", r6("external_rate")
    )


@query("overlay_allocation")
def overlay_allocation(spark, sf):
    # services get their minimum; job3 stands for a job without a suggestion
    nodes = _services(spark, sf).withColumn("_min", q.min_servers(F.col("lam"), F.col("mu")))
    suggested = written(nodes.select(
        "job", "tick", "component", F.when(F.col("job") != "job3", F.col("_min")).alias("executors")
    ), "suggested")
    current = topology.allocation_counts(d.executors(spark, sf)).drop("kind")
    return topology.overlay_allocation(current, suggested).select("job", "tick", "component", "executors")


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Allocation snapshots, as long as the job has events; written once as the log they stand for."""
    return written(d.allocation_snapshots(spark, sf), "allocations")


def _allocations(spark: SparkSession, sf: str) -> DataFrame:
    return written(timeline.allocation_as_of(_snapshots(spark, sf), d.last_tick(spark, sf)), "allocations")


@query("allocation_changed")
def allocation_changed(spark, sf):
    now = _allocations(spark, sf)
    before = now.withColumn("tick", F.col("tick") + 1)
    changed = topology.allocation_changed(before, now, ("job", "tick"))
    return changed.join(now.select("job", "tick").distinct(), ["job", "tick"], "left_semi").filter("tick > 1")


@query("allocation_counts")
def allocation_counts(spark, sf):
    return topology.allocation_counts(d.executors(spark, sf)).select("job", "component", "executors")


@query("component_tasks")
def component_tasks(spark, sf):
    rows = topology.component_tasks(d.executors(spark, sf))
    return rows.select(
        "job", "component", F.array_join(F.transform("tasks", lambda t: t.cast("string")), ",").alias("tasks")
    )


@query("component_executors")
def component_executors(spark, sf):
    text = F.transform("ranges", lambda r: F.concat_ws("-", r["task_start"].cast("string"), r["task_end"].cast("string")))
    return topology.component_executors(d.executors(spark, sf)).select(
        "job", "component", F.array_join(text, ",").alias("ranges")
    )


@query("task_hosts")
def task_hosts(spark, sf):
    return topology.task_hosts(d.executors(spark, sf))


@query("assignment_map")
def assignment_map(spark, sf):
    rows = topology.assignment_map(d.executors(spark, sf))
    return rows.select("job", "component", F.explode("assignment").alias("executor", "place"))


@query("topology_info")
def topology_info(spark, sf):
    info = topology.topology_info(d.components(spark, sf), d.edges(spark, sf))
    per_component = info.select(
        "job", F.array_join("sources", ",").alias("sources"), F.array_join("services", ",").alias("services"),
        F.explode("targets").alias("component", "streams"),
    )
    return per_component.select(
        "job", "sources", "services", "component", F.explode_outer("streams").alias("stream", "to")
    ).select(
        "job", "sources", "services", "component", "stream", F.array_join("to", ",").alias("targets")
    )


@query("allocation_totals")
def allocation_totals(spark, sf):
    return topology.allocation_totals(topology.allocation_counts(d.executors(spark, sf)))


@query("pick_source")
def pick_source(spark, sf):
    # every component stands for a source here: the first name counts
    per_source = moments.cmv_aggregate(d.tuple_events(spark, sf), ["job", "component"], "elapsed_ms")
    return topology.pick_source(per_source).select(*cmv("job", "component"))


# --- aggregations ------------------------------------------------------------

@query("cmv_aggregate")
def cmv_aggregate(spark, sf):
    items = d.table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate"))
    weeks = timeline.tumbling_bucket(items, 7 * d.DAY)
    rows = moments.cmv_aggregate(weeks, ["l_returnflag", "l_linestatus", "bucket"], "l_quantity")
    return rows.select(*cmv("l_returnflag", "l_linestatus", naive("bucket")))


@query("cmv_merge")
def cmv_merge(spark, sf):
    return moments.cmv_merge(d.task_moments(spark, sf), ["job", "component"]).select(*cmv("job", "component"))


@query("cmv_stats")
def cmv_stats(spark, sf):
    rows = moments.cmv_aggregate(d.tuple_events(spark, sf), ["job", "component", "stream"], "elapsed_ms")
    return moments.with_cmv_stats(rows).select(
        *cmv("job", "component", "stream"), r6("avg"), r6("avg2"), r6("var"), r6("scv")
    )


@query("executor_rollup")
def executor_rollup(spark, sf):
    days = written(d.task_days(spark, sf), "task-days")
    rows = moments.executor_rollup(d.moments_of_days(days), d.executors_of_days(days, idle=True))
    return rows.select(*cmv("job", "tick", "component", "executor", "stream"))


@query("executor_results")
def executor_results(spark, sf):
    days = written(d.task_days(spark, sf), "task-days")
    rows = moments.executor_results(
        d.reports_of_days(days, d.executors_of_days(days)), d.executors_of_days(days, idle=True)
    )
    # averages of short decimals: their squares tie at six places, not at eight
    parts = [F.round(f"{c}_{p}", 8).alias(f"{c}_{p}") for c in queue_columns() for p in ("s", "ss")]
    return rows.select(
        *cmv("job", "tick", "component", "executor"), "duration_ms", *[f"{c}_cnt" for c in queue_columns()], *parts
    )


@query("component_rollup")
def component_rollup(spark, sf):
    days = written(d.task_days(spark, sf), "task-days")
    per_executor = moments.executor_rollup(d.moments_of_days(days), d.executors_of_days(days))
    return moments.component_rollup(per_executor).select(*cmv("job", "tick", "component", "stream"))


@query("queue_aggregate")
def queue_aggregate(spark, sf):
    rows = moments.queue_aggregate(d.executor_reports(spark, sf), ["job", "tick", "component"])
    # averages of short decimals: their squares tie at six places, not at eight
    parts = [F.round(f"{c}_{p}", 8).alias(f"{c}_{p}") for c in queue_columns() for p in ("s", "ss")]
    return rows.select("job", "tick", "component", *[f"{c}_cnt" for c in queue_columns()], *parts)


@query("duration_sum")
def duration_sum(spark, sf):
    return moments.duration_sum(d.executor_reports(spark, sf), ["job", "tick", "component"])


@query("stream_combine")
def stream_combine(spark, sf):
    rows = moments.stream_combine(d.task_moments(spark, sf), ["job", "component"], keep_streams=True)
    return rows.select(*cmv("job", "component", "stream"))


@query("history_rollup")
def history_rollup(spark, sf):
    totals, allocation = d.totals_and_allocation(spark, sf)
    dense = timeline.dense_ticks(written(totals, "totals"), allocation)
    rows = timeline.history_rollup(dense, HISTORY)
    return rows.select(
        *cmv("job", "tick", "component"), r6("duration_ms"), "recv_rate_cnt", r6("recv_rate_s"),
        "send_population_cnt", r6("send_population_s"),
    )


@query("latency_histogram")
def latency_histogram(spark, sf):
    items = d.table(spark, sf, "lineitem").withColumn("key", F.concat("l_returnflag", "l_linestatus"))
    return moments.latency_histogram(items, ["key"], "l_quantity", d.CUTS)


@query("latency_histogram_text")
def latency_histogram_text(spark, sf):
    daily = timeline.tumbling_bucket(d.tuple_events(spark, sf), d.DAY)
    rows = moments.latency_histogram_text(
        daily, ["job", "component", "stream", "bucket"], "elapsed_ms", d.CUTS, F.col("outcome") == "fail"
    )
    return rows.select("job", "component", "stream", naive("bucket"), "histogram", "fails")


@query("qos_miss")
def qos_miss(spark, sf):
    limit = F.when(F.col("kind") == "source", d.SOURCE_THRESHOLD_MS).otherwise(d.SERVICE_THRESHOLD_MS)
    done = d.tuple_events(spark, sf).filter(F.col("outcome") == "ok")
    rows = moments.qos_miss(done, ["job", "component", "stream"], "elapsed_ms", limit)
    return rows.select(*cmv("job", "component", "stream"))


@query("emit_count")
def emit_count(spark, sf):
    # a tuple of work emits none, one or two tuples here
    emits = (F.col("event_id") % 3).alias("emits")
    events = d.tuple_events(spark, sf).select("job", "component", "task", "stream", "ts", "event_id", emits)
    daily = timeline.tumbling_bucket(events, d.DAY)
    rows = moments.emit_count(
        daily, ["job", "component", "stream", "bucket"], ["job", "task"], ["ts", "event_id"], SAMPLE, "emits"
    )
    return rows.select("job", "component", "stream", naive("bucket"), "emitted")


@query("measure_events")
def measure_events(spark, sf):
    params = Params(bucket_seconds=d.DAY, latency_threshold_ms=d.SOURCE_THRESHOLD_MS, histogram_cuts=d.CUTS)
    rows = measure.task_measurements(d.tuple_events(spark, sf), params)
    return rows.select(
        *cmv("job", naive("bucket"), "component", "task", "stream"), "emitted", "miss_cnt", r6("miss_s"), r6("miss_ss"),
        "fails", *[f"bin{i}" for i in range(len(d.CUTS) + 1)],
    )


# --- timeline ----------------------------------------------------------------

@query("tumbling_bucket")
def tumbling_bucket(spark, sf):
    hours = timeline.tumbling_bucket(d.tuple_events(spark, sf), 3600)
    rows = hours.groupBy("job", "component", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("job", "component", naive("bucket"), "n")


@query("report_duration")
def report_duration(spark, sf):
    daily = timeline.tumbling_bucket(d.tuple_events(spark, sf), d.DAY)
    reports = daily.groupBy("job", "task", "bucket").agg(F.max("ts").alias("ts")).select("job", "task", "ts")
    return timeline.report_duration(reports, d.start()).select("job", "task", naive("ts"), "duration_ms")


@query("optimise_tick")
def optimise_tick(spark, sf):
    ticked = d.tuple_events(spark, sf).withColumn("tick", d.day_tick("ts"))
    return ticked.groupBy("job", "tick").agg(F.count(F.lit(1)).alias("n"))


@query("history_window")
def history_window(spark, sf):
    # job and task: some tasks are silent on some days
    ticks = d.task_moments(spark, sf).select("job", "task", "tick").distinct()
    return timeline.history_window(ticks, HISTORY, ["job", "task"])


@query("warmup_gate")
def warmup_gate(spark, sf):
    params = Params(history_size=HISTORY, history_ignore=1)
    ticks = d.task_moments(spark, sf).select("job", "component", "tick").distinct()
    return timeline.warmup_gate(ticks, params, "tick")


@query("unallocated_totals")
def unallocated_totals(spark, sf):
    # no snapshot before tick 3, and one component never in any
    lacking = _snapshots(spark, sf).filter("tick >= 3 AND NOT (job = 'job1' AND component = 'error')")
    return timeline.unallocated_totals(d.totals(spark, sf), lacking).select("job", "tick", "component", "cnt")


@query("allocation_epoch")
def allocation_epoch(spark, sf):
    return timeline.allocation_epochs(_allocations(spark, sf))


@query("adjust_gate")
def adjust_gate(spark, sf):
    params = Params(interval_seconds=d.DAY, adjust_min_seconds=6 * d.DAY)
    ticks = d.task_moments(spark, sf).select("job", "tick").distinct()
    return timeline.adjust_gate(ticks, params)


# --- dataflow ----------------------------------------------------------------

def _records(spark: SparkSession, sf: str) -> DataFrame:
    return d.text_records(spark, sf).select("sid", "sentence")


@query("split_stream")
def split_stream(spark, sf):
    return dataflow.split_stream(_records(spark, sf), PATH_P)


@query("named_outputs")
def named_outputs(spark, sf):
    """One service that sends a record to none, one or two streams, and a consumer for each of them."""
    text = F.col("sentence")
    emitted = dataflow.emit(_records(spark, sf), {
        "long": (F.length(text) > 60, text), "even": (F.length(text) % 2 == 0, F.substring(text, 1, 10)),
        "unheard": (F.lit(True), text),
    })
    return dataflow.consume(emitted, {"long": lambda w: F.concat(w, F.lit("+")), "even": lambda w: F.concat(F.lit("-"), w)})


@query("loop_through")
def loop_through(spark, sf):
    """A loop whose service adds the number of the pass to the word."""
    words = dataflow.forward_words(_records(spark, sf))
    return dataflow.loop_through(words, lambda rows, j: rows.withColumn("word", F.concat("word", F.lit(f":{j}"))), LOOP_P)


@query("merge_streams")
def merge_streams(spark, sf):
    parts = written(dataflow.split_stream(_records(spark, sf), PATH_P), "routed")
    taken = dataflow.on_stream(parts, dataflow.TAKEN).withColumn("sentence", F.concat(F.lit("P:"), "sentence"))
    return dataflow.merge_streams(taken, dataflow.on_stream(parts, dataflow.NOT_TAKEN))


@query("shuffle_grouping")
def shuffle_grouping(spark, sf):
    return dataflow.shuffle_grouping(_records(spark, sf), 16)


@query("loop_back")
def loop_back(spark, sf):
    return dataflow.loop_back(dataflow.forward_words(_records(spark, sf)), LOOP_P)


@query("dataflow_chain")
def dataflow_chain(spark, sf):
    return dataflows.dataflow_chain(_records(spark, sf))


@query("dataflow_two_path")
def dataflow_two_path(spark, sf):
    return dataflows.dataflow_two_path(
        _records(spark, sf), PATH_P, lambda word: F.concat(word, F.lit("+")), lambda word: F.concat(word, F.lit("-"))
    )


@query("dataflow_loop")
def dataflow_loop(spark, sf):
    return dataflows.dataflow_loop(_records(spark, sf), LOOP_P).select(F.col("word").alias("word_finished"), "sid")


# --- queueing table ----------------------------------------------------------

@query("source_nodes")
def source_nodes(spark, sf):
    rows = capacity.source_nodes(_history(spark, sf), PARAMS)
    numbers = ("real_ms", "real_scv", "duration_seconds", "complete_rate", "emit_rate", "external_rate",
               "send_length", "recv_length", "emit_scv", "external_scv")
    return rows.select("job", "tick", "component", "executors", "completed", *[r6(c) for c in numbers])


@query("service_nodes")
def service_nodes(spark, sf):
    history = _history(spark, sf)
    rows = capacity.service_nodes(history, _sources(history), PARAMS)
    numbers = ("lam", "mu", "ratio", "service_ms", "cs2", "ca2", "duration_seconds", "complete_rate",
               "send_length", "recv_length")
    return rows.select("job", "tick", "component", "executors", "completed", r11("rho"), *[r6(c) for c in numbers])


@query("utilisation")
def utilisation(spark, sf):
    lam, mu, e = F.col("lam"), F.col("mu"), F.col("executors")
    return _services(spark, sf).select(
        "job", "tick", "component", r11(q.utilisation(lam, mu, e), "rho_now"),
        q.is_stable(lam, mu, e).alias("stable"), r11(q.utilisation(lam, mu, F.lit(1)), "rho_single"),
    )


@query("min_servers")
def min_servers(spark, sf):
    return _services(spark, sf).select(
        "job", "tick", "component", q.min_servers(F.col("lam"), F.col("mu")).alias("min_executors")
    )


def _curve(spark: SparkSession, sf: str, models: tuple[str, ...] = ("mmk",)) -> DataFrame:
    nodes = _services(spark, sf)
    lowest = q.min_servers(F.col("lam"), F.col("mu"))
    return capacity.capacity_curve(nodes, lowest, lowest + CURVE_MORE, models)


@query("capacity_curve")
def capacity_curve(spark, sf):
    return _curve(spark, sf).select("job", "tick", "component", "k", r11("rho"), "stable", r6("wait_s"))


@query("erlang_wait")
def erlang_wait(spark, sf):
    lam, mu, e = F.col("lam"), F.col("mu"), F.col("executors")
    return _services(spark, sf).select(
        "job", "tick", "component", r6(q.erlang_wait(lam, mu, e), "wait_now"),
        r6(q.erlang_wait(lam, mu, F.lit(40)), "wait_forty"),
    )


def _sojourn_query(model: str) -> Query:
    def run(spark, sf):
        return _curve(spark, sf, (model,)).select("job", "tick", "component", "k", r6(f"sojourn_{model}", "sojourn_s"))

    return run


for _model in GRID_MODELS:
    QUERIES[f"sojourn_{_model}"] = _sojourn_query(_model)


@query("sojourn_mm1")
def sojourn_mm1(spark, sf):
    return _services(spark, sf).select(
        "job", "tick", "component", r6(q.sojourn_mm1(F.col("lam") / F.col("executors"), F.col("mu")), "sojourn_s")
    )


@query("network_sojourn")
def network_sojourn(spark, sf):
    nodes = written(_services(spark, sf), "nodes")
    rows = None
    for model in GRID_MODELS:
        one = capacity.network_sojourn(nodes, plan.SCOPE, model).withColumn("model", F.lit(model))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("job", "tick", "model", r6("est_s"), "stable")


@query("calibrate")
def calibrate(spark, sf):
    nodes = _services(spark, sf)
    est = capacity.with_sojourn(nodes, "mmk", "_now").groupBy("job", "tick").agg(
        (F.sum(capacity.visit_time(F.col("_now"))) * 1000.0).alias("est_ms"), F.first("real_ms").alias("real_ms")
    )
    ratio, error = capacity.calibrate(F.col("real_ms"), F.col("est_ms"))
    return est.select("job", "tick", r6("real_ms"), r6("est_ms"), r6(ratio, "ratio_real"), r6(error, "error_pct"))


# --- allocation and decision -------------------------------------------------

@query("marginal_gain")
def marginal_gain(spark, sf):
    rows = capacity.with_gain(_curve(spark, sf), plan.SCOPE).filter(F.col("gain").isNotNull())
    return rows.select("job", "tick", "component", "k", r6("gain"))


@query("best_gain")
def best_gain(spark, sf):
    return allocate.best_gain(_services(spark, sf)).select("job", "tick", "component", "k", r6("gain"))


@query("broken_nodes")
def broken_nodes(spark, sf):
    rows = allocate.broken_nodes(_services(spark, sf), F.lit(BUDGET), plan.SCOPE, LONGEST)
    return rows.select("job", "tick", "component", "min_executors", "room")


def _greedy_query(model: str) -> Query:
    def run(spark, sf):
        return allocate.allocate_greedy(_services(spark, sf), F.lit(BUDGET), plan.SCOPE, model)

    return run


for _model in GRID_MODELS:
    QUERIES["allocate_greedy" if _model == "mmk" else f"allocate_greedy_{_model}"] = _greedy_query(_model)


@query("allocate_min_qos")
def allocate_min_qos(spark, sf):
    return allocate.allocate_min_qos(_services(spark, sf), F.lit(QOS_MS / 2), F.lit(2 * BUDGET))


def _check_query(model: str) -> Query:
    def run(spark, sf):
        nodes = _services(spark, sf).withColumns({
            "current_budget": F.col("service_executors"), "max_budget": F.lit(BUDGET)
        })
        rows = allocate.check_optimized(nodes, QOS_MS, plan.SCOPE, model)
        return _result(rows.drop("sources"))

    return run


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job", "tick", "component", "objective", "executors", "current", "status",
        r6("real_ms"), r6("est_ms"), r6("ratio_real"), r6("error_pct"), "stable",
    )


for _model in GRID_MODELS:
    QUERIES["check_optimized" if _model == "mmk" else f"check_optimized_{_model}"] = _check_query(_model)


@query("max_executors")
def max_executors(spark, sf):
    totals = topology.allocation_totals(topology.allocation_counts(d.executors(spark, sf)))
    running = F.col("source_executors") + F.col("service_executors")
    derived = Params(workers=2, executors_per_worker=3)
    return totals.select(
        "job", plan.max_executors(derived, running).cast("int").alias("derived_limit"),
        plan.max_executors(PARAMS, running).cast("int").alias("configured_limit"),
    )


@query("service_budget")
def service_budget(spark, sf):
    totals, allocation = d.totals_and_allocation(spark, sf)
    nodes = plan.nodes_of(written(totals, "totals"), allocation, PARAMS)
    return nodes.select("job", "tick", "current_budget", "max_budget").distinct()


@query("num_workers")
def num_workers(spark, sf):
    counts = topology.allocation_counts(d.executors(spark, sf))
    return counts.groupBy("job").agg(plan.num_workers(F.sum("executors"), Params(executors_per_worker=6)).alias("workers"))


def _optimised(spark: SparkSession, sf: str, params: Params = PARAMS) -> DataFrame:
    return plan.optimise(*d.totals_and_allocation(spark, sf), params)


@query("optimise")
def optimise(spark, sf):
    return _result(_optimised(spark, sf, LARGE))


@query("optimise_current")
def optimise_current(spark, sf):
    return _result(_optimised(spark, sf))


@query("optimise_epochs")
def optimise_epochs(spark, sf):
    return _result(plan.optimise(d.totals(spark, sf), _snapshots(spark, sf), PARAMS))


@query("optimise_metric_log")
def optimise_metric_log(spark, sf):
    """The offline path: recorded log lines to recommendations."""
    measured, _, _ = readers.scan_metric_log(spark, _log_folder(spark, sf))
    execs = written(d.executors(spark, sf), "executors")
    totals, _ = plan.totals_of_reports(measured, execs, PARAMS)
    return _result(plan.optimise(totals, topology.allocation_counts(execs), PARAMS))


def _decision(adjust_type: int) -> Params:
    return Params(
        interval_seconds=d.DAY, history_size=HISTORY, start=d.START, qos_ms=QOS_MS, max_executors=BUDGET + 4,
        adjust_min_seconds=8 * d.DAY, adjust_type=adjust_type, executors_per_worker=6,
    )


@query("decide")
def decide(spark, sf):
    result = written(_optimised(spark, sf), "result")
    rows = None
    for kind in (0, 1, 2, 7):
        one = plan.decide(result, _decision(kind)).withColumn("adjust_type", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("adjust_type", "job", "tick", "component", "executors")


@query("rebalance_plan")
def rebalance_plan(spark, sf):
    params = _decision(1)
    return plan.rebalance_plan(written(plan.decide(_optimised(spark, sf, params), params), "decision"), params)


def _recorded(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Write records to a log folder and read back what is no task report."""
    path = fresh_path(spark, "records")
    writers.sink_metric_log(lines, path)
    return readers.scan_metric_log(spark, path)[1]


@query("alloc_record")
def alloc_record(spark, sf):
    history = written(_history(spark, sf), "history")
    sources = _sources(history)
    context = plan.record_context(sources, capacity.service_nodes(history, sources, PARAMS))
    lines = plan.alloc_record(_optimised(spark, sf), context)
    return _record_rows(spark, lines)


def _record_rows(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Records written to a log and read back, a row per service node."""
    # the tick travels in the job's name, since a record has no member for it
    named = lines.select(F.concat_ws("@", "job", F.col("tick").cast("string")).alias("job"), "value")
    one = readers.read_alloc_records(_recorded(spark, named)).select(
        F.substring_index("job", "@", 1).alias("job"), F.substring_index("job", "@", -1).cast("int").alias("tick"),
        F.col("record").alias("r"), "record.context",
    )

    def text(column: str) -> Column:
        pairs = F.transform(
            F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
        )
        return F.array_join(pairs, ",")

    whole = [
        "job", "tick", F.col("r.status").alias("status"), text("r.currOptAllocation").alias("current"),
        text("r.kMaxOptAllocation").alias("maximum"), text("r.minReqOptAllocation").alias("min_qos"),
        r6(F.col("context.latency.realLatency"), "real_ms"), r6(F.col("context.latency.estimate"), "est_ms"),
        r6(F.col("context.latency.ratio"), "ratio_real"), r6(F.col("context.latency.error"), "error_pct"),
        F.col("context.spout.component").alias("source"), r6(F.col("context.spout.external_rate"), "external_rate"),
    ]
    return one.select(*whole, F.explode("context.bolt").alias("component", "node")).select(
        *[c if isinstance(c, str) else F.col(n) for c, n in zip(whole, one.select(*whole).columns)], "component",
        F.col("node.executors").alias("executors"), r6(F.col("node.lam"), "lam"), r6(F.col("node.mu"), "mu"),
        r11(F.col("node.rho"), "rho"), r6(F.col("node.ratio"), "ratio"), r6(F.col("node.service_ms"), "service_ms"),
    )


@query("topology_record")
def topology_record(spark, sf):
    info = topology.topology_info(d.components(spark, sf), d.edges(spark, sf))
    read = readers.read_topology_records(_recorded(spark, plan.topology_record(info)))
    return read.select(
        "job", F.col("record.id").alias("id"), F.array_join("record.spouts", ",").alias("sources"),
        F.array_join("record.bolts", ",").alias("services"), F.explode("record.targets").alias("component", "streams"),
    ).select("job", "id", "sources", "services", "component", F.explode_outer("streams").alias("stream", "to")).select(
        "job", "id", "sources", "services", "component", "stream", F.array_join("to", ",").alias("targets")
    )


# --- streaming ---------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = d.table(spark, sf, "events").schema
    source = in_utc(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return d.shape_events(source)


def _finite_stream(spark: SparkSession, sf: str) -> tuple[DataFrame, tuple]:
    """The events as a stream that can be closed, and what closes it."""
    events, folder = _event_stream(spark, sf), fresh_path(spark, "closing")
    return live.closable(events, folder), (events.schema, folder)


@query("stream_cmv")
def stream_cmv(spark, sf):
    keys = ["job", "component", "task", "stream"]
    events, closing = _finite_stream(spark, sf)
    rows = live.drained(spark, live.stream_cmv(events, keys, "elapsed_ms", d.DAY), "stream-cmv", closing)
    return rows.select(*cmv(naive("bucket"), *keys))


@query("stream_history")
def stream_history(spark, sf):
    keys = ["job", "component"]
    events, closing = _finite_stream(spark, sf)
    stream = live.stream_history(events, keys, "elapsed_ms", d.DAY, HISTORY)
    rows = live.drained(spark, stream, "stream-history", closing)
    return rows.select(*cmv(naive("history_start"), naive("history_end"), *keys))


def _closed_days(events: DataFrame) -> DataFrame:
    """Live counterpart of the per-task days: one row per task, stream and closed day."""
    measured = d.measured_ms()
    return (
        events.withColumn("_x", measured).withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", f"{d.DAY} seconds"), "job", "component", "kind", "task", "stream")
        .agg(
            F.count(F.lit(1)).alias("arrivals"), F.sum("elapsed_ms").alias("total_ms"), F.count("_x").alias("cnt"),
            F.coalesce(F.sum("_x"), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0)).alias("ss"),
        )
        .withColumn("day", F.col("window.start")).drop("window")
    )


def _live(spark: SparkSession, sf: str, allocation, params: Params) -> str:
    """Run the live tick over all events and close it; returns its folder."""
    folder = fresh_path(spark, "stream-optimise")
    execs = written(d.executors(spark, sf), "executors")
    events, closing = _finite_stream(spark, sf)
    held = allocation(execs)

    def to_totals(batch: DataFrame) -> DataFrame:
        return moments.component_totals(d.reports_of_days(batch, execs))

    def run() -> None:
        live.stream_optimise(_closed_days(events), to_totals, held, params, folder).awaitTermination()

    run()
    live.close(spark, *closing)
    run()
    return folder


@query("stream_optimise")
def stream_optimise(spark, sf):
    return _result(live.stream_results(spark, _live(spark, sf, topology.allocation_counts, PARAMS)))


@query("stream_rebalance")
def stream_rebalance(spark, sf):
    """The loop to its end: allocation snapshots in, changes of the allocation out."""
    snapshots = _snapshots(spark, sf)
    folder = _live(spark, sf, lambda _: lambda: snapshots, _decision(1))
    return live.stream_changes(spark, folder)


def _resent_log(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A log in which one job's reports stand twice, and some are of tasks that no executor has; and the executors."""
    measured = written(_measured(spark, sf), "measured")
    strange = measured.filter("component = 'error'").withColumn("task", F.col("task") + 1000)
    path = fresh_path(spark, "resent-log")
    writers.sink_metric_log(writers.report_lines(measured.unionByName(measured.filter("job = 'job1'")).unionByName(strange)), path)
    return path, written(d.executors(spark, sf), "executors")


def _live_reports(spark: SparkSession, sf: str, params: Params) -> str:
    """Run the live tick over log lines and a stream of snapshots, and close it; returns its folder."""
    path, execs = _resent_log(spark, sf)
    base = fresh_path(spark, "stream-reports")
    stamp = (d.start() + F.make_dt_interval(F.col("tick"))).alias("ts")
    _snapshots(spark, sf).select(stamp, "job", F.col("tick").cast("int").alias("tick"), "component", "kind", "executors").write.parquet(f"{base}/snapshots")
    kind = spark.read.parquet(f"{base}/snapshots").schema
    measured, _, _ = readers.parse_metric_log(reports.read_log_stream(in_utc(spark), path))
    told = live.closable(measured, f"{base}/end-of-reports")
    held = live.closable(spark.readStream.schema(kind).parquet(f"{base}/snapshots"), f"{base}/end-of-snapshots")

    def run() -> None:
        reports.stream_tick(reports.closed_totals(told, execs, params), held, params, base).awaitTermination()

    run()
    live.close(spark, measured.schema, f"{base}/end-of-reports")
    live.close(spark, kind, f"{base}/end-of-snapshots")
    run()
    return base


@query("stream_metric_log")
def stream_metric_log(spark, sf):
    """Log lines and allocation snapshots as streams, to recommendations."""
    return _result(live.stream_results(spark, _live_reports(spark, sf, PARAMS)))


@query("stream_alloc_record")
def stream_alloc_record(spark, sf):
    return _record_rows(spark, live.stream_records(spark, _live_reports(spark, sf, PARAMS)))


@query("stream_unknown_tasks")
def stream_unknown_tasks(spark, sf):
    """The live reject stream beside the live tick."""
    path, execs = _resent_log(spark, sf)
    measured, _, _ = readers.parse_metric_log(reports.read_log_stream(in_utc(spark), path))
    unknown = live.drained(spark, reports.unknown_reports(measured, execs), "stream-unknown")
    return unknown.select("job", naive("ts"), "component", "task", F.size("data").alias("n_values"))


@query("stream_stateful_counter")
def stream_stateful_counter(spark, sf):
    folder = fresh_path(spark, "stream-counter")
    rows = _event_stream(spark, sf).select("job", "task", "ts", "event_id")
    live.stream_stateful_counter(rows, ["job", "task"], ["ts", "event_id"], folder, SAMPLE).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("job", "task", "event_id", "position", "sampled")
