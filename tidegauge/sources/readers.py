"""Scans: metric points, metric logs, text queues, cluster snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.points import measured_points
from tidegauge.schemas import EXECUTORS, METRIC_POINTS

# The log line format.
ARROW = "->"
TASK_RECORD = r"^task\.(.+)\.(\d+)$"
STAMP = "timestamp"
# The end of the year 9999.
LAST_MILLIS = 253402300799999


def read_metric_points(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(METRIC_POINTS).parquet(path)


def scan_metric_points(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """Reports of user components, with approved names and non-empty values only."""
    return measured_points(read_metric_points(spark, path), aliases)


def _log_lines(lines: DataFrame) -> DataFrame:
    """Split every line at its first arrow; ``body`` is NULL without one."""
    name = F.substring_index("value", ARROW, 1)
    at = F.instr("value", ARROW)
    body = F.when(at > 0, F.expr(f"substring(value, instr(value, '{ARROW}') + {len(ARROW)})"))
    job = F.col("job").cast("string") if "job" in lines.columns else F.lit(None).cast("string")
    return lines.select(job.alias("job"), "value", name.alias("name"), body.alias("body"))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log folder, with ``job`` as it was written where the folder is split by job."""
    lines = spark.read.text(path)
    # without its type a job named 007 would be read back as the number 7
    return spark.read.schema("value string, job string").text(path) if "job" in lines.columns else lines


def parse_metric_log(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(measured, others, rejects)``.

    Task records become reports, every other record keeps its name and body.
    Lines without an arrow, and task records whose body is not a JSON object,
    whose task id is no 32-bit number or whose time lies beyond the year 9999,
    are rejects. A report takes its time from the ``timestamp`` entry, else it
    counts as read now.
    """
    split = _log_lines(lines)
    head = F.col("name").rlike(TASK_RECORD)
    values = F.from_json("body", "map<string,string>")
    parsed = split.withColumn("_task", head & F.col("body").isNotNull()).withColumn(
        "_values", F.when(F.col("_task") & F.col("body").rlike(r"^\s*\{"), values)
    )
    parsed = parsed.withColumn("_id", F.regexp_extract("name", TASK_RECORD, 2).try_cast("int")).withColumn(
        "_millis", F.try_element_at("_values", F.lit(STAMP)).try_cast("bigint")
    )
    timed = F.col("_millis").isNull() | F.col("_millis").between(0, LAST_MILLIS)
    good = F.col("_task") & F.col("_values").isNotNull() & F.col("_id").isNotNull() & timed
    nested = F.transform_values(
        F.map_filter("_values", lambda k, v: k != STAMP),
        lambda k, v: F.struct(
            v.try_cast("double").alias("num"),
            F.when(v.startswith("{"), F.from_json(v, "map<string,string>")).alias("kv"),
        ),
    )
    # the bound again, since a filter does not guard a column of the same step
    stamp = F.timestamp_millis(F.when(timed, F.col("_millis")))
    measured = parsed.filter(good).select(
        "job",
        F.coalesce(stamp, F.current_timestamp()).alias("ts"),
        F.regexp_extract("name", TASK_RECORD, 1).alias("component"),
        F.col("_id").alias("task"),
        nested.alias("data"),
    )
    others = parsed.filter(F.col("body").isNotNull() & ~head).select("job", "name", "body")
    rejects = parsed.filter(F.col("body").isNull() | (F.col("_task") & ~good)).select("job", "value")
    return measured, others, rejects


def scan_metric_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_metric_log(read_metric_log(spark, path))


def _nodes(names: tuple[str, ...], whole: tuple[str, ...]) -> str:
    kinds = {"component": "string", "executors": "int", "completed": "bigint"}
    return f"struct<{','.join(f'{n}:{kinds.get(n, 'double')}' for n in (*whole, *names))}>"


def read_alloc_records(others: DataFrame, name: str = "alloc") -> DataFrame:
    """``(job, record)`` of the allocation records among :func:`parse_metric_log`'s other records."""
    counts = "map<string,int>"
    latency = "struct<realLatency:double,estimate:double,ratio:double,error:double>"
    source = _nodes(("real_ms", "real_scv", "completed", "duration_seconds", "complete_rate", "emit_rate", "external_rate",
                     "send_length", "recv_length"), ("component", "executors"))
    service = _nodes(("lam", "mu", "rho", "ratio", "service_ms", "cs2", "ca2", "complete_rate", "send_length",
                      "recv_length"), ("executors", "completed"))
    schema = (
        f"struct<status:string,minReqOptAllocation:{counts},currOptAllocation:{counts},kMaxOptAllocation:{counts},"
        f"context:struct<latency:{latency},spout:{source},bolt:map<string,{service}>>>"
    )
    return others.filter(F.col("name") == name).select("job", F.from_json("body", schema).alias("record"))


def read_topology_records(others: DataFrame, name: str = "topology.info") -> DataFrame:
    """``(job, record)`` of the topology records among the other records."""
    schema = "struct<id:string,spouts:array<string>,bolts:array<string>,targets:map<string,map<string,array<string>>>>"
    return others.filter(F.col("name") == name).select("job", F.from_json("body", schema).alias("record"))


def scan_text_queue(
    spark: SparkSession, folder: str, binary: bool = False, files_per_trigger: int | None = None,
    consume: str = "off", archive: str | None = None,
) -> DataFrame:
    """Text records as a stream; files dropped into ``folder`` are the queue.

    The stream's checkpoint takes the place of popping: each record is read
    once. With ``consume`` at ``delete`` or ``archive`` a file leaves the folder
    once the batch after its own begins, that is when its records are committed;
    ``archive`` moves it below that folder, which must lie outside the queue.
    What the newest batch has read stays until there is another one, see
    :func:`~tidegauge.sources.queue.take_all`.
    """
    if consume not in ("off", "delete", "archive") or (consume == "archive") != (archive is not None):
        raise ValueError(f"consume is off, delete, or archive with its folder: {consume}, {archive}")
    reader = spark.readStream.option("lineSep", "\n").option("cleanSource", consume)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    text = reader.text(folder).withColumnRenamed("value", "text")
    return text.select(F.encode("text", "UTF-8").alias("text")) if binary else text


def scan_peek(lines: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` records by a stable order, without consuming them."""
    return lines.orderBy(*order).limit(n)


def scan_cluster_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Executors of all running jobs."""
    return spark.read.schema(EXECUTORS).format(fmt).load(path)
