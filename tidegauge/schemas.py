"""Table schemas, fixed vocabulary and run parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Metric names, queue fields and the built-in renames a report may carry.
COMPLETE_LATENCY = "complete-latency"
MISS_QOS = "miss-qos"
LATENCY_STAT = "latency-stat"
EXECUTE = "execute"
DURATION = "duration"
SEND_QUEUE = "send-queue"
RECV_QUEUE = "recv-queue"
EMIT = "emit"
SERIALIZED = "serialized"
QUEUE_FIELDS = {
    "rate": "arrival_rate_secs",
    "capacity": "capacity",
    "population": "population",
    "sojourn": "sojourn_time_ms",
}
APPROVED_NAMES = (
    "__sendqueue send-queue",
    "__receive recv-queue",
    "complete-latency",
    "execute",
    "emit",
    "duration",
)
SYSTEM_PREFIX = "__"

QUEUES = ("recv", "send")
QUEUE_METRIC = {"recv": RECV_QUEUE, "send": SEND_QUEUE}
CMV = ("cnt", "s", "ss")

METRIC_POINTS = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("component", T.StringType()),
    T.StructField("task", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("kv", T.MapType(T.StringType(), T.StringType())),
])

METRIC_VALUE = T.StructType([
    T.StructField("num", T.DoubleType()),
    T.StructField("kv", T.MapType(T.StringType(), T.StringType())),
])

MEASURED = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("component", T.StringType()),
    T.StructField("task", T.IntegerType()),
    T.StructField("data", T.MapType(T.StringType(), METRIC_VALUE)),
])

EXECUTORS = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("task_start", T.IntegerType()),
    T.StructField("task_end", T.IntegerType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
])


def queue_columns() -> list[str]:
    """Flat columns of one queue report: ``recv_rate`` ... ``send_sojourn``."""
    return [f"{q}_{m}" for q in QUEUES for m in QUEUE_FIELDS]


# The queue numbers the model reads.
MODEL_QUEUES = ("recv_rate", "send_rate", "recv_population", "send_population")


def total_columns() -> list[str]:
    """Everything that is added up from task to component and over the history."""
    return [*CMV, "duration_ms", *[f"{c}_{p}" for c in MODEL_QUEUES for p in ("cnt", "s")]]


@dataclass(frozen=True)
class Params:
    """Run parameters with the documented defaults.

    ``sample_rate`` is one value for measuring and modelling, 1.0 by default.
    ``max_executors`` of -1 derives the limit from workers and executors per worker.
    ``start`` is when optimising began; without it every job starts at its first report.
    """

    bucket_seconds: int = 60
    sample_rate: float = 1.0
    history_size: int = 1
    history_ignore: int = 0
    interval_seconds: int = 30
    adjust_min_seconds: int | None = None
    adjust_type: int = 0
    qos_ms: float = 5000.0
    max_executors: int = -1
    executors_per_worker: int = 8
    workers: int = 1
    latency_threshold_ms: float | None = None
    histogram_cuts: tuple[float, ...] = ()
    approved_names: tuple[str, ...] = APPROVED_NAMES
    model: str = "mmk"
    policy: str = "default"
    start: str | None = None

    @property
    def adjust_min(self) -> int:
        return self.adjust_min_seconds if self.adjust_min_seconds is not None else 2 * self.interval_seconds
