"""Sinks: metric logs and raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import EMIT, RECV_QUEUE, SEND_QUEUE
from tidegauge.sources.readers import ARROW, STAMP


def _quoted(text: Column) -> Column:
    """JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _member(entry: Column) -> Column:
    """``"name":value``; queue numbers and emit counts stay numbers inside their map."""
    numeric = entry["key"].isin(RECV_QUEUE, SEND_QUEUE, EMIT)
    kv = entry["value"]["kv"]
    body = F.when(numeric, F.to_json(F.transform_values(kv, lambda k, v: v.try_cast("double")))).otherwise(F.to_json(kv))
    number = entry["value"]["num"].cast("string")
    return F.concat(_quoted(entry["key"]), F.lit(":"), F.coalesce(number, body))


def report_json(data: Column, ts: Column | None = None) -> Column:
    members = F.transform(
        F.array_sort(F.map_entries(data), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), _member
    )
    if ts is not None:
        stamp = F.concat(F.lit(f'"{STAMP}":'), F.unix_millis(ts).cast("string"))
        members = F.concat(members, F.array(stamp))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def report_lines(measured: DataFrame, stamped: bool = True) -> DataFrame:
    """``task.<component>.<task>->{json}`` per report."""
    name = F.concat_ws(".", F.lit("task"), "component", F.col("task").cast("string"))
    ts = F.col("ts") if stamped else None
    return measured.select("job", F.concat(name, F.lit(ARROW), report_json(F.col("data"), ts)).alias("value"))


def sink_metric_log(lines: DataFrame, path: str, enabled: bool = True) -> None:
    """Append record lines to the log folder, split by job; nothing if not enabled.

    The rebalance gathers the lines of small jobs and splits those of large ones,
    so the number of files follows the data and not tasks times jobs.
    """
    if enabled:
        balanced = lines.select("job", "value").hint("rebalance", "job")
        balanced.write.mode("append").partitionBy("job").text(path)


def sink_raw_lines(lines: DataFrame, path: str, order: list[str], n: int, column: str = "value") -> None:
    """The first ``n`` raw lines to a text folder, one line per record."""
    lines.orderBy(*order).limit(n).select(column).write.text(path)
