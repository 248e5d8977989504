"""Executors, components and allocations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.points import is_system


def executor_tasks(executors: DataFrame) -> DataFrame:
    """One row per task of every executor."""
    return executors.withColumn("task", F.explode(F.sequence("task_start", "task_end")))


def tasks_to_executors(reports: DataFrame, executors: DataFrame) -> DataFrame:
    """Add the executor (its first task) and the kind of component to each report.

    Feed reports that are already added up per task: then no single task is
    large. Whether the executor side is broadcast is left to its measured size.
    """
    tasks = executor_tasks(executors).select(
        "job", "task", F.col("task_start").alias("executor"), F.col("kind")
    )
    side = reports.drop("kind") if "kind" in reports.columns else reports
    return side.join(tasks, ["job", "task"])


def unknown_tasks(reports: DataFrame, executors: DataFrame) -> DataFrame:
    """Reports whose task belongs to no executor."""
    tasks = executor_tasks(executors).select("job", "task")
    return reports.join(tasks, ["job", "task"], "left_anti")


def first_task_only(reports: DataFrame, executors: DataFrame) -> DataFrame:
    """Reports of the first task of an executor, so a shared queue counts once."""
    first = executors.select("job", F.col("task_start").alias("task"))
    return reports.join(first, ["job", "task"], "left_semi")


def split_by_kind(reports: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports of sources, and reports of everything else."""
    sources = components.filter(F.col("kind") == "source").select("job", "component")
    flagged = reports.join(
        sources.withColumn("_source", F.lit(True)), ["job", "component"], "left"
    )
    return (
        flagged.filter(F.col("_source")).drop("_source"),
        flagged.filter(F.col("_source").isNull()).drop("_source"),
    )


def allocation_counts(executors: DataFrame) -> DataFrame:
    """Executors per component."""
    return executors.groupBy("job", "component", "kind").agg(F.count(F.lit(1)).cast("int").alias("executors"))


def with_allocation(rows: DataFrame, allocation: DataFrame) -> DataFrame:
    """Add the current executor count; per tick where the allocation has ticks."""
    on = ["job", "component"] + (["tick"] if "tick" in allocation.columns else [])
    return rows.join(allocation.select(*on, "executors"), on)


def allocation_totals(allocation: DataFrame, by: tuple[str, ...] = ("job",)) -> DataFrame:
    """Executors of sources and of services."""
    count = F.col("executors")
    source = F.col("kind") == "source"
    return allocation.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(source, count)), F.lit(0)).cast("int").alias("source_executors"),
        F.coalesce(F.sum(F.when(~source, count)), F.lit(0)).cast("int").alias("service_executors"),
    )


def overlay_allocation(current: DataFrame, suggested: DataFrame) -> DataFrame:
    """Current allocation with suggested components overwritten.

    A job whose suggestion is empty (``suggested`` has it with NULL executors)
    keeps an empty result.
    """
    scope = [c for c in suggested.columns if c not in ("component", "executors")]
    fresh = suggested.select(*scope, "component", F.col("executors").alias("_new"))
    whole = suggested.groupBy(*scope).agg(F.bool_and(F.col("executors").isNotNull()).alias("_known"))
    frame = current.join(whole, [c for c in scope if c in current.columns])
    return (
        frame.join(fresh, [*scope, "component"], "left")
        .withColumn("executors", F.when(F.col("_known"), F.coalesce("_new", "executors")))
        .drop("_new", "_known")
    )


def allocation_changed(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("job",)) -> DataFrame:
    """Per job: do the two component -> count maps differ in any way?"""
    keys = [*by, "component"]
    left = old.select(*keys, F.col("executors").alias("_old"))
    right = new.select(*keys, F.col("executors").alias("_new"))
    return (
        left.join(right, keys, "full_outer")
        .groupBy(*by)
        .agg(F.bool_or(~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))
    )


def component_tasks(executors: DataFrame, with_system: bool = False) -> DataFrame:
    """Task ids of every component, ascending."""
    kept = executors if with_system else executors.filter(~is_system(F.col("component")))
    return (
        executor_tasks(kept)
        .groupBy("job", "component")
        .agg(F.array_sort(F.collect_list("task")).alias("tasks"))
    )


def component_executors(executors: DataFrame) -> DataFrame:
    """Task ranges of every component."""
    return executors.groupBy("job", "component").agg(
        F.array_sort(F.collect_list(F.struct("task_start", "task_end"))).alias("ranges")
    )


def task_hosts(executors: DataFrame) -> DataFrame:
    return executor_tasks(executors).select("job", "task", "host")


def assignment_map(executors: DataFrame) -> DataFrame:
    """Task range -> ``host:port`` for every component."""
    key = F.format_string("[%d, %d]", "task_start", "task_end")
    place = F.concat_ws(":", "host", F.col("port").cast("string"))
    return executors.groupBy("job", "component").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), place.alias("value"))))).alias(
            "assignment"
        )
    )


def topology_info(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Per job: sources, services and ``component -> stream -> targets``."""
    streams = edges.groupBy("job", "component", "stream").agg(
        F.array_sort(F.collect_set("target")).alias("targets")
    )
    per_component = streams.groupBy("job", "component").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "targets")))).alias("streams")
    )
    listed = components.join(per_component, ["job", "component"], "left")
    none = F.expr("cast(map() as map<string, array<string>>)")
    entry = F.struct(F.col("component"), F.coalesce("streams", none).alias("streams"))
    # sorting by the component alone: a map cannot be compared
    by_name = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["component"] < b["component"], -1).when(a["component"] > b["component"], 1).otherwise(0),
    )
    source = F.col("kind") == "source"
    return listed.groupBy("job").agg(
        F.array_sort(F.collect_list(F.when(source, F.col("component")))).alias("sources"),
        F.array_sort(F.collect_list(F.when(~source, F.col("component")))).alias("services"),
        F.map_from_entries(by_name).alias("targets"),
    )


def pick_source(sources: DataFrame, by: tuple[str, ...] = ("job",)) -> DataFrame:
    """One source per job: the smallest name."""
    w = Window.partitionBy(*by).orderBy("component")
    return sources.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
