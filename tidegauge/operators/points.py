"""From raw metric points to one report per task."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.moments import cmv_parts
from tidegauge.schemas import (
    COMPLETE_LATENCY,
    DURATION,
    EXECUTE,
    QUEUE_FIELDS,
    QUEUE_METRIC,
    QUEUES,
    SYSTEM_PREFIX,
)


def parse_approved_names(lines: DataFrame, line: str = "line", position: str = "position") -> DataFrame:
    """Configuration lines to ``(name, alias)``; a later line replaces an earlier one.

    ``lines`` holds one configuration line per row.
    """
    part = F.split(F.trim(F.col(line)), r"\s+")
    parsed = lines.filter(F.trim(F.col(line)) != "").select(
        F.element_at(part, 1).alias("name"),
        F.when(F.size(part) > 1, F.try_element_at(part, F.lit(2))).otherwise(F.element_at(part, 1)).alias("alias"),
        F.col(position).alias("_position"),
    )
    # the newest line of a name, as one mergeable aggregate
    return parsed.groupBy("name").agg(F.max_by("alias", "_position").alias("alias"))


def approved_names(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """:func:`parse_approved_names` over lines given in the configuration."""
    given = list(lines)
    # an arrow table becomes a local relation, whose size the planner knows
    table = pa.table({"position": pa.array(range(len(given)), pa.int32()), "line": pa.array(given, pa.string())})
    return parse_approved_names(spark.createDataFrame(table))


def approved_metrics(points: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keep approved points and rename them to their alias."""
    columns = [F.col("alias").alias("name") if c == "name" else F.col(c) for c in points.columns]
    return points.join(aliases, "name").select(*columns)


def is_system(component: Column) -> Column:
    return component.startswith(SYSTEM_PREFIX)


def drop_system_components(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """Drop rows of reserved components; ``keep`` replaces the default rule."""
    return df.filter(keep if keep is not None else ~is_system(F.col("component")))


def drop_empty_points(points: DataFrame, keep: Column | None = None) -> DataFrame:
    """Drop points without a value or with an empty map; ``keep`` replaces the rule."""
    filled = F.col("num").isNotNull() | (F.coalesce(F.size("kv"), F.lit(0)) > 0)
    return points.filter(keep if keep is not None else filled)


def pivot_points(points: DataFrame) -> DataFrame:
    """Fold the points of one report into one ``name -> value`` map, whatever the names are.

    Two points of the same name in one report are an error. A report is as
    large as its map, and the map as the list of approved names.
    """
    keys = ["job", "ts", "component", "task"]
    entry = F.struct(F.col("name").alias("key"), F.struct("num", "kv").alias("value"))
    folded = points.groupBy(*keys).agg(F.collect_list(entry).alias("_entries"))
    names = F.transform("_entries", lambda e: e["key"])
    twice = F.size(F.array_distinct(names)) < F.size(names)
    data = F.map_from_entries("_entries")
    checked = F.when(twice, F.raise_error(F.lit("two points of the same name in one report"))).otherwise(data)
    return folded.select(*keys, checked.alias("data"))


def measured_points(points: DataFrame, aliases: DataFrame) -> DataFrame:
    """System filter, approval, empty filter and fold in one plan."""
    return pivot_points(drop_empty_points(approved_metrics(drop_system_components(points), aliases)))


def _value(name: str) -> Column:
    return F.try_element_at(F.col("data"), F.lit(name))


def moment_map(kind: Column) -> Column:
    """The stream map a component of ``kind`` reports: completions or executions."""
    return F.when(kind == "source", _value(COMPLETE_LATENCY)["kv"]).otherwise(_value(EXECUTE)["kv"])


def parse_cmv(measured: DataFrame) -> DataFrame:
    """One row per stream with its ``cnt, s, ss``; streams without samples vanish.

    ``measured`` must carry ``kind``.
    """
    keep = [c for c in measured.columns if c != "data"]
    return (
        measured.select(*keep, F.explode(moment_map(F.col("kind"))).alias("stream", "text"))
        .select(*keep, "stream", cmv_parts(F.col("text")).alias("cmv"))
        .filter(F.col("cmv.cnt") > 0)
        .select(*keep, "stream", "cmv.cnt", "cmv.s", "cmv.ss")
    )


def queue_fields(measured: DataFrame) -> DataFrame:
    """Flat queue numbers and duration of each report.

    A report without a queue leaves its columns NULL; a queue report that lacks
    a field counts as zero.
    """
    columns = []
    for q in QUEUES:
        kv = _value(QUEUE_METRIC[q])["kv"]
        for short, field in QUEUE_FIELDS.items():
            number = F.coalesce(F.try_element_at(kv, F.lit(field)).try_cast("double"), F.lit(0.0))
            columns.append(F.when(kv.isNotNull(), number).alias(f"{q}_{short}"))
    keep = [c for c in measured.columns if c != "data"]
    return measured.select(*keep, _value(DURATION)["num"].alias("duration_ms"), *columns)


def report_totals(measured: DataFrame) -> DataFrame:
    """One flat row per report: all streams added, plus queues and duration.

    The stream map is added up inside the row, so nothing is exploded.
    """
    parts = F.filter(
        F.transform(F.map_values(moment_map(F.col("kind"))), cmv_parts), lambda p: p["cnt"] > 0
    )

    def added(field: str, zero) -> Column:
        return F.coalesce(F.aggregate(parts, zero, lambda acc, p: acc + p[field]), zero).alias(field)

    return queue_fields(
        measured.select(
            "*", added("cnt", F.lit(0).cast("bigint")), added("s", F.lit(0.0)), added("ss", F.lit(0.0))
        )
    )
