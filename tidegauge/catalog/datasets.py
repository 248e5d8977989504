"""Views over the given tables that look like measurements of running jobs.

Everything is derived by Spark from ``events``, ``lineitem`` and
``conversations``, so the work of each query grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.moments import cmv_text
from tidegauge.operators.moments import component_totals
from tidegauge.operators.timeline import bucket_start, optimise_tick
from tidegauge.operators.topology import allocation_counts
from tidegauge.schemas import COMPLETE_LATENCY, DURATION, EMIT, EXECUTE, QUEUE_FIELDS, QUEUE_METRIC
from tidegauge.session import in_utc, written

# Fixed values of the fixture.
START = "2024-01-01 00:00:00"
DAY = 86400
RATE_SCALE = 259200.0
COMPONENTS = ("click", "error", "purchase", "signup", "view")
EXECUTORS_EACH = 4
QUEUE_CAPACITY = 1024
CUTS = (10.0, 25.0, 50.0, 100.0, 200.0)
SERVICE_THRESHOLD_MS = 100.0
SOURCE_THRESHOLD_MS = 800.0
SUCCESSOR = {"view": "click", "click": "error", "error": "purchase", "purchase": "signup"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shape_events(events: DataFrame) -> DataFrame:
    """Four jobs; ``view`` is the source, the other event types are services."""
    source = F.col("event_type") == "view"
    index = F.lit(len(COMPONENTS) - 1)
    for i, name in enumerate(COMPONENTS[:-1]):
        index = F.when(F.col("event_type") == name, F.lit(i)).otherwise(index)
    return events.select(
        F.concat(F.lit("job"), (F.col("user_id") % 4).cast("string")).alias("job"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("component"),
        F.when(source, F.lit("source")).otherwise(F.lit("service")).alias("kind"),
        (index * 8 + F.floor(F.col("user_id") / 4) % 8).cast("int").alias("task"),
        F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("stream"),
        (F.col("value") * F.when(source, F.lit(8)).otherwise(F.lit(1))).alias("elapsed_ms"),
        F.when(F.col("event_id") % 50 == 0, F.lit("fail")).otherwise(F.lit("ok")).alias("outcome"),
    )


def tuple_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def measured_ms():
    """What an event adds to the moments: nothing for failed source tuples and zero times."""
    done = (F.col("kind") != "source") | (F.col("outcome") == "ok")
    timed = (F.col("kind") == "source") | (F.col("elapsed_ms") > 0)
    return F.when(done & timed, F.col("elapsed_ms"))


def task_days(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Per task, stream and day: arrivals and moments. The one pass over the events."""
    rows = events if events is not None else tuple_events(spark, sf_dir)
    x = measured_ms()
    return (
        rows.withColumn("day", bucket_start("ts", DAY)).withColumn("_x", x)
        .groupBy("job", "day", "component", "kind", "task", "stream")
        .agg(
            F.count(F.lit(1)).alias("arrivals"),
            F.sum("elapsed_ms").alias("total_ms"),
            F.count("_x").alias("cnt"),
            F.coalesce(F.sum("_x"), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0)).alias("ss"),
        )
    )


def moments_of_days(days: DataFrame) -> DataFrame:
    """``(job, tick, component, kind, task, stream, cnt, s, ss)`` with daily ticks."""
    return (
        days.withColumn("tick", day_tick("day"))
        .groupBy("job", "tick", "component", "kind", "task", "stream")
        .agg(F.sum("cnt").alias("cnt"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        .filter(F.col("cnt") > 0)
    )


def task_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments_of_days(task_days(spark, sf_dir))


def start():
    return F.lit(START).cast("timestamp")


def day_tick(ts: str):
    return optimise_tick(F.col(ts), start(), DAY)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuple_events(spark, sf_dir).select("job", "component", "kind").distinct()


def executors_from(comps: DataFrame, idle: bool = False) -> DataFrame:
    """Four executors of two consecutive tasks for every component.

    With ``idle`` one more that no event belongs to, on tasks from 1000 on.
    """
    index = F.lit(len(COMPONENTS) - 1)
    for i, name in enumerate(COMPONENTS[:-1]):
        index = F.when(F.col("component") == name, F.lit(i)).otherwise(index)
    slot = F.col("slot")
    return comps.select(
        "job", "component", "kind",
        F.explode(F.sequence(F.lit(0), F.lit(EXECUTORS_EACH - 1 + int(idle)))).alias("slot"),
    ).withColumn(
        "_base", index * 8 + F.when(slot < EXECUTORS_EACH, 0).otherwise(1000)
    ).select(
        "job", "component", "kind",
        (F.col("_base") + 2 * slot).cast("int").alias("task_start"),
        (F.col("_base") + 2 * slot + 1).cast("int").alias("task_end"),
        F.concat(F.lit("h"), (slot % 3).cast("string")).alias("host"),
        (slot + 6700).cast("int").alias("port"),
    )


def executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executors_from(components(spark, sf_dir))


def executors_of_days(days: DataFrame, idle: bool = False) -> DataFrame:
    """The executors of everything that has a day in ``days``."""
    return executors_from(days.select("job", "component", "kind").distinct(), idle)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component feeds the next one through every stream seen in its events."""
    nxt = F.lit(None).cast("string")
    for name, target in SUCCESSOR.items():
        nxt = F.when(F.col("component") == name, F.lit(target)).otherwise(nxt)
    return (
        tuple_events(spark, sf_dir).select("job", "component", "stream").distinct()
        .withColumn("target", nxt).filter(F.col("target").isNotNull())
    )


def _queue_numbers():
    arrivals, total = F.col("arrivals"), F.col("total_ms")
    sojourn = total / arrivals
    return [
        F.lit(DAY * 1000.0).alias("duration_ms"),
        (arrivals * RATE_SCALE / DAY).alias("recv_rate"),
        F.lit(float(QUEUE_CAPACITY)).alias("recv_capacity"),
        arrivals.cast("double").alias("recv_population"),
        sojourn.alias("recv_sojourn"),
        # an acknowledgement goes out with every tuple, so twice the arrivals leave
        (arrivals * 2 * RATE_SCALE / DAY).alias("send_rate"),
        F.lit(float(QUEUE_CAPACITY)).alias("send_capacity"),
        arrivals.cast("double").alias("send_population"),
        sojourn.alias("send_sojourn"),
    ]


def _per_executor_day(days: DataFrame, execs: DataFrame) -> DataFrame:
    tasks = execs.select(
        "job", F.col("task_start").alias("executor"), F.explode(F.sequence("task_start", "task_end")).alias("task")
    )
    return (
        days.join(tasks, ["job", "task"])
        .groupBy("job", "day", "component", "kind", "executor")
        .agg(*[F.sum(c).alias(c) for c in ("arrivals", "total_ms", "cnt", "s", "ss")])
    )


def queue_samples(days: DataFrame, execs: DataFrame) -> DataFrame:
    """One queue report per executor and day, from the executor's first task."""
    return _per_executor_day(days, execs).select(
        "job", "day", "component", "kind", F.col("executor").alias("task"), *_queue_numbers()
    )


def reports_of_days(days: DataFrame, execs: DataFrame) -> DataFrame:
    """Flat executor reports per day: moments, queue numbers and duration."""
    return _per_executor_day(days, execs).select(
        "job", day_tick("day").alias("tick"), "component", "kind", "executor", "cnt", "s", "ss", *_queue_numbers()
    )


def executor_reports(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Reports and executors from one pass over the events."""
    days = written(task_days(spark, sf_dir, events), "task-days")
    return reports_of_days(days, executors_of_days(days))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component totals per daily tick."""
    return component_totals(executor_reports(spark, sf_dir))


def totals_and_allocation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Component totals per tick and executors per component, from one pass over the events."""
    days = written(task_days(spark, sf_dir), "task-days")
    execs = executors_of_days(days)
    return component_totals(reports_of_days(days, execs)), allocation_counts(execs)


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points as tasks report them, with the noise a collector has to drop."""
    days = written(task_days(spark, sf_dir), "task-days")
    execs = executors_of_days(days)
    keys = ["job", "day", "component", "task"]
    kv_none = F.lit(None).cast("map<string,string>")
    per_task = days.groupBy(*keys, "kind").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("stream").alias("key"), cmv_text(F.col("cnt"), F.col("s"), F.col("ss")).alias("value")
        ))).alias("moments"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("stream").alias("key"), F.col("arrivals").cast("string").alias("value")
        ))).alias("emits"),
    )
    no_num = F.lit(None).cast("double")

    def point(name, num, kv):
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("name"), num.alias("num"), kv.alias("kv")
        )

    moment_name = F.when(F.col("kind") == "source", F.lit(COMPLETE_LATENCY)).otherwise(F.lit(EXECUTE))
    task_points = per_task.select(*keys, F.explode(F.array(
        point(moment_name, no_num, F.col("moments")),
        point(EMIT, no_num, F.col("emits")),
        # noise: a name nobody approved, an empty map, a missing value
        point("junk", F.lit(1.0), kv_none),
        point("latency-stat", no_num, F.expr("cast(map() as map<string,string>)")),
        point("miss-qos", no_num, kv_none),
    )).alias("p")).select(*keys, "p.*")

    def queue_map(q):
        pairs = []
        for short, field in QUEUE_FIELDS.items():
            pairs += [F.lit(field), F.col(f"{q}_{short}").cast("string")]
        return F.create_map(*pairs)

    raw_name = {"recv": "__receive", "send": "__sendqueue"}
    queue_points = queue_samples(days, execs).select(*keys, F.explode(F.array(
        *[point(raw_name[q], no_num, queue_map(q)) for q in QUEUE_METRIC],
        point(DURATION, F.col("duration_ms"), kv_none),
    )).alias("p")).select(*keys, "p.*")
    # noise: the same queue reports once more, from a reserved component
    system = queue_points.filter(F.col("name") == "__receive").withColumn("component", F.lit("__acker"))
    return (
        task_points.unionByName(queue_points).unionByName(system)
        .select("job", F.col("day").alias("ts"), "component", "task", "name", "num", "kv")
    )


def last_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuple_events(spark, sf_dir).groupBy("job").agg(F.max(day_tick("ts")).alias("_last"))


def allocation_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four executors each; from tick 15 on ``job0/click`` has six. Every fifth tick from 2 on has no snapshot."""
    grown = (F.col("job") == "job0") & (F.col("component") == "click") & (F.col("tick") >= 15)
    ended = components(spark, sf_dir).join(last_tick(spark, sf_dir), "job")
    return ended.select(
        "job", "component", "kind", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("tick")
    ).filter(F.col("tick") % 5 != 2).withColumn("executors", F.when(grown, F.lit(6)).otherwise(F.lit(EXECUTORS_EACH)))


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversations.select(
        F.concat_ws("-", F.lit("s"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sid"),
        F.col("text").alias("sentence"),
        "conv_id", "turn",
    )
