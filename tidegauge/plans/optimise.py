"""The whole tick: totals -> history -> nodes -> allocations -> decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import allocate, capacity, moments, points, timeline, topology
from tidegauge.schemas import MODEL_QUEUES, Params
from tidegauge.session import written

SCOPE = ("job", "tick")


def max_executors(params: Params, running: Column) -> Column:
    """Executor limit of a job: configured, or workers times executors per worker."""
    if params.max_executors != -1:
        return F.lit(params.max_executors)
    needed = num_workers(running, params)
    return F.greatest(F.lit(params.workers), needed) * params.executors_per_worker


def num_workers(executors: Column, params: Params) -> Column:
    return F.ceil(executors / params.executors_per_worker).cast("int")


def totals_of_reports(measured: DataFrame, executors: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Component totals per tick from one report per task, and the reports of tasks that no executor has.

    One pass: stream maps are added inside the row, queues and durations count
    for the first task of each executor only.
    """
    placed = topology.tasks_to_executors(measured, executors)
    first = F.col("task") == F.col("executor")
    flat = points.report_totals(placed)
    queue = [F.when(first, F.col(c)).alias(c) for c in ("duration_ms", *MODEL_QUEUES)]
    reports = flat.select("job", "ts", "component", "kind", "cnt", "s", "ss", *queue)
    return moments.component_totals(timeline.with_tick(reports, params)), topology.unknown_tasks(measured, executors)


def ready_history(
    totals: DataFrame, allocation: DataFrame, params: Params, reach: DataFrame | None = None
) -> DataFrame:
    """History per job, tick and component after the warm-up, with ``executors``.

    ``allocation`` is constant, or has snapshots at some ticks, of which the
    last one holds, or the spans of such snapshots
    (:func:`~tidegauge.operators.timeline.allocation_spans`); then every change
    drops its tick, clears the history and restarts the warm-up.
    ``reach(job, _first)`` leaves out earlier ticks.
    """
    if "tick" in allocation.columns:
        dense = timeline.dense_epochs(totals, allocation, reach)
    elif "start" in allocation.columns:
        dense = timeline.dense_spans(totals, allocation, reach)
    else:
        dense = timeline.dense_ticks(totals, allocation, reach)
        dense = dense.withColumn("epoch", F.lit(0)).withColumn("tick_in_epoch", F.col("tick"))
    history = timeline.history_rollup(dense, params.history_size, ("job", "epoch", "component"))
    return timeline.warmup_gate(history, params)


def due_history(totals: DataFrame, allocation: DataFrame, params: Params, due: DataFrame | None = None) -> DataFrame:
    """:func:`ready_history` of the ``due`` ticks of each job only, from no more totals than they need."""
    if due is None:
        return ready_history(totals, allocation, params)
    # work of a live tick: only what the history of the due ticks covers
    reach = due.select("job", (F.col("first_due") - (params.history_size - 1)).alias("_first"))
    wanted = F.col("tick").between(F.col("first_due"), F.col("last_due"))
    return ready_history(totals, allocation, params, reach).join(due, "job").filter(wanted).drop("first_due", "last_due")


def nodes_of(
    totals: DataFrame, allocation: DataFrame, params: Params, due: DataFrame | None = None
) -> DataFrame:
    """Service nodes per tick with the budgets of their job."""
    return nodes_of_history(due_history(totals, allocation, params, due), params)


def nodes_of_history(history: DataFrame, params: Params) -> DataFrame:
    running = F.col("source_executors") + F.col("service_executors")
    return capacity.network_nodes(history, params, SCOPE).withColumns({
        "current_budget": F.col("service_executors"),
        "max_budget": (max_executors(params, running) - F.col("source_executors")).cast("int"),
    })


RESULT_SCHEMA = (
    "job string, tick int, component string, objective string, executors int, current int, status string, "
    "real_ms double, est_ms double, ratio_real double, error_pct double, stable boolean"
)
CHANGE_SCHEMA = "job string, tick int, component string, old_executors int, new_executors int, workers int"
RESULT = tuple(column.split()[0] for column in RESULT_SCHEMA.split(", "))


def optimise(
    totals: DataFrame, allocation: DataFrame, params: Params, due: DataFrame | None = None
) -> DataFrame:
    """One row per job, tick, component and objective.

    The totals hold one row per component and tick, the reduced form of the raw
    input. They are written once, since their last tick is needed beside them.
    ``due`` (``job, first_due, last_due``) restricts the ticks that get a result.
    """
    return optimise_history(due_history(written(totals, "totals"), allocation, params, due), params)


def optimise_history(history: DataFrame, params: Params) -> DataFrame:
    """:func:`optimise` from the history on."""
    return full_allocation(allocate.check_optimized(nodes_of_history(history, params), params.qos_ms, SCOPE, params.model))


def full_allocation(suggested: DataFrame) -> DataFrame:
    """Lay the suggestion over the allocation of the whole job.

    Every service has a suggested row, so the overlay only adds the sources: they
    keep their count wherever the job has a suggestion. The first service of a
    job carries them, which spares a second pass over the suggestion.
    """
    first = F.min("component").over(Window.partitionBy("job", "tick", "objective")) == F.col("component")
    own = F.struct("component", "executors", "current")
    unchanged = F.transform(
        "sources",
        lambda held: F.struct(
            held["component"].alias("component"),
            F.when(F.col("executors").isNotNull(), held["executors"]).alias("executors"),
            held["executors"].alias("current"),
        ),
    )
    rest = [c for c in RESULT if c not in ("component", "executors", "current")]
    return (
        suggested.withColumn("_first", first)
        .select(*rest, F.explode(F.when(F.col("_first"), F.concat(F.array(own), unchanged)).otherwise(F.array(own)))
                .alias("_row"))
        .select(*rest, "_row.*")
        .select(*RESULT)
    )


# Adjustment type -> objective; any other number acts like 0.
ADJUST_TYPES = {0: "current", 1: "max", 2: "min_qos"}


def _by_type(result: DataFrame, params: Params) -> DataFrame:
    objective = ADJUST_TYPES.get(params.adjust_type, "current")
    chosen = result.filter(F.col("objective") == objective)
    return timeline.adjust_gate(chosen, params).filter(F.col("executors").isNotNull())


def _never(result: DataFrame, params: Params) -> DataFrame:
    return result.filter(F.lit(False))


# A policy picks rows of the result. Add an entry to plug in another.
POLICIES: dict[str, Callable[[DataFrame, Params], DataFrame]] = {"default": _by_type, "none": _never}


def decide(result: DataFrame, params: Params) -> DataFrame:
    """The allocation each job should take per tick; jobs without one are absent."""
    return POLICIES[params.policy](result, params)


def rebalance_plan(decision: DataFrame, params: Params) -> DataFrame:
    """Component changes of the jobs whose decision differs from what they run."""
    per_job = decision.groupBy("job", "tick").agg(
        F.bool_or(~F.col("executors").eqNullSafe(F.col("current"))).alias("changed"),
        num_workers(F.sum("executors"), params).alias("workers"),
    )
    return (
        decision.join(per_job.filter("changed"), list(SCOPE))
        .select(
            "job", "tick", "component",
            F.col("current").alias("old_executors"), F.col("executors").alias("new_executors"), "workers",
        )
    )


SOURCE_MEMBERS = ("component", "executors", "real_ms", "real_scv", "completed", "duration_seconds", "complete_rate",
                  "emit_rate", "external_rate", "send_length", "recv_length")
SERVICE_MEMBERS = ("executors", "completed", "lam", "mu", "rho", "ratio", "service_ms", "cs2", "ca2", "complete_rate",
                   "send_length", "recv_length")


def record_context(sources: DataFrame, services: DataFrame) -> DataFrame:
    """``(job, tick, spout, bolt)``: the source node and the service nodes by name, as the record carries them."""
    spout = sources.select("job", "tick", F.struct(*SOURCE_MEMBERS).alias("spout"))
    bolt = services.groupBy("job", "tick").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("component").alias("key"), F.struct(*SERVICE_MEMBERS).alias("value")
    )))).alias("bolt"))
    return bolt.join(topology.pick_source(spout.select("*", "spout.component"), SCOPE).drop("component"), list(SCOPE), "left")


def history_context(history: DataFrame, params: Params) -> DataFrame:
    """:func:`record_context` of every tick in ``history``; hand in a written table."""
    sources = capacity.source_nodes(history, params)
    return record_context(sources, capacity.service_nodes(history, topology.pick_source(sources, SCOPE), params))


def alloc_record(result: DataFrame, context: DataFrame | None = None, record: str = "alloc") -> DataFrame:
    """One log line ``record->{json}`` per job and tick; ``context`` adds the nodes (see :func:`record_context`)."""
    def chosen(objective: str) -> Column:
        hit = (F.col("objective") == objective) & F.col("executors").isNotNull()
        pairs = F.collect_list(F.when(hit, F.struct("component", "executors")))
        return F.when(F.size(pairs) > 0, F.map_from_entries(F.array_sort(pairs)))

    grouped = result.groupBy("job", "tick").agg(
        F.first("status").alias("status"),
        chosen("min_qos").alias("minReqOptAllocation"),
        chosen("current").alias("currOptAllocation"),
        chosen("max").alias("kMaxOptAllocation"),
        F.first("real_ms").alias("realLatency"),
        F.first("est_ms").alias("estimate"),
        F.first("ratio_real").alias("ratio"),
        F.first("error_pct").alias("error"),
    )
    parts = [F.struct("realLatency", "estimate", "ratio", "error").alias("latency")]
    if context is not None:
        grouped = grouped.join(context, list(SCOPE), "left")
        parts += ["spout", "bolt"]
    # fixed values: the member names of the record
    body = F.struct(
        "status", "minReqOptAllocation", "currOptAllocation", "kMaxOptAllocation", F.struct(*parts).alias("context")
    )
    return grouped.select("job", "tick", F.concat(F.lit(record + "->"), F.to_json(body)).alias("value"))


def topology_record(info: DataFrame, record: str = "topology.info") -> DataFrame:
    """One log line per job of :func:`~tidegauge.operators.topology.topology_info`."""
    # fixed values: the member names of the record
    body = F.struct(F.col("job").alias("id"), F.col("sources").alias("spouts"), F.col("services").alias("bolts"), "targets")
    return info.select("job", F.concat(F.lit(record + "->"), F.to_json(body)).alias("value"))
