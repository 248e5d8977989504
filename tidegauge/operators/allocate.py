"""Executor allocation by a threshold of gain, for all jobs, ticks and goals in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import queueing as q
from tidegauge.operators.capacity import calibrate, node_stable, visit_time, with_sojourn
from tidegauge.operators.gains import LONGEST_CURVE, broken, gain_curves, steps_taken
from tidegauge.session import spread, written


def _floors(nodes: DataFrame, top: Column, scope: Sequence[str]) -> DataFrame:
    """Add the smallest stable allocation, and the ``room`` that the scope has above it up to ``top``.

    ``fits`` is false for a scope without room or with a broken node.
    """
    per_scope = Window.partitionBy(*scope)
    floors = spread(nodes, *scope).withColumn("min_executors", q.min_servers(F.col("lam"), F.col("mu"))).withColumn(
        "floor_total", F.sum("min_executors").over(per_scope)
    ).withColumn("room", F.coalesce(top, F.lit(0)) - F.col("floor_total"))
    fits = F.bool_and(~broken(F.col("min_executors"), F.col("room"))).over(per_scope) & (F.col("room") >= 0)
    return floors.withColumn("fits", F.coalesce(fits, F.lit(False)))


def _curves(floors: DataFrame, scope: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Gain curves, each computed on its own, so one large job is spread too; none for a scope that does not fit."""
    each = spread(floors, *scope, "component")
    curves = gain_curves(each, F.when(F.col("fits"), F.col("room")).otherwise(F.lit(-1)), models)
    arrays = [f"{a}_{m}" for m in models for a in ("head", "sojourn")]
    whole = F.struct(*[c for c in curves.columns if c not in (*scope, "component", *arrays)]).alias("node")
    return written(curves.select(*scope, "component", "ratio", *arrays, whole), "gain-curves")


def _goal(name: str, model: str, steps: Column | None = None, floor_s: Column | None = None, adjust: Column | None = None,
          target_s: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("goal"), F.lit(model).alias("model"),
        (none if steps is None else F.when(steps >= 0, steps)).cast("bigint").alias("steps"),
        (none if floor_s is None else floor_s).cast("double").alias("floor_s"),
        (none if adjust is None else adjust).cast("double").alias("adjust"),
        (none if target_s is None else target_s).cast("double").alias("target_s"),
    )


def _per_scope(curves: DataFrame, scope: Sequence[str], goals: Sequence[Column], extra: Sequence[Column]) -> DataFrame:
    """One row per scope and goal; ``extra`` are the aggregates that the goals are made of."""
    facts = curves.groupBy(*scope).agg(*extra)
    return facts.select(*scope, F.explode(F.array(*goals)).alias("_goal")).select(*scope, "_goal.*")


def _qos_goal(target_ms: Column, adjust: Column, delta_s: float) -> Column:
    """Reach the target, if it can be reached at all with what the services take alone."""
    target = target_ms / 1000.0
    reachable = F.col("_fits") & (F.col("_service_s") * adjust + F.lit(delta_s) < target)
    return _goal("min_qos", "mmk", floor_s=F.col("_floor_s"), adjust=adjust, target_s=F.when(reachable, target))


def _qos_facts() -> list[Column]:
    return [
        F.sum(F.get("sojourn_mmk", F.lit(0)) * F.col("ratio")).alias("_floor_s"),
        F.sum(1 / F.col("node.mu")).alias("_service_s"), F.first("node.fits").alias("_fits"),
    ]


def _executors(room: Column) -> Column:
    """Executors of a component for a goal; NULL where the goal cannot be had, a latency goal within ``room``."""
    within = F.col("target_s").isNotNull() & F.col("met") & (F.col("all_taken") <= room)
    had = F.col("node.fits") & (F.col("steps").isNotNull() | within)
    return F.when(had, F.col("node.min_executors") + F.col("taken")).cast("int")


def best_gain(nodes: DataFrame, scope: Sequence[str] = ("job", "tick"), model: str = "mmk") -> DataFrame:
    """The component that gets the first executor beyond the minimum."""
    floors = nodes.withColumn("min_executors", q.min_servers(F.col("lam"), F.col("mu")))
    head = F.get(f"head_{model}", F.lit(0))
    curves = gain_curves(spread(floors, *scope, "component"), F.lit(1), (model,)).withColumn("gain", head)
    # a component's first step has its gain as head
    first = F.min(F.struct((-F.col("gain")).alias("_order"), "component", F.col("min_executors").alias("k"), "gain"))
    return curves.filter("gain IS NOT NULL").groupBy(*scope).agg(first.alias("_best")).select(
        *scope, "_best.component", "_best.k", "_best.gain"
    )


def allocate_greedy(
    nodes: DataFrame, budget: str | Column, scope: Sequence[str] = ("job", "tick"), model: str = "mmk"
) -> DataFrame:
    """Best use of ``budget`` executors; NULL executors where it is too small, or a node is broken (see :func:`broken_nodes`)."""
    limit = F.col(budget) if isinstance(budget, str) else budget
    curves = _curves(_floors(nodes, limit, scope), scope, (model,))
    goals = _per_scope(curves, scope, [_goal("budget", model, steps=F.col("_room"))], [F.first("node.room").alias("_room")])
    return steps_taken(curves, goals, scope, (model,)).select(
        *scope, "component", "node.min_executors", _executors(F.col("node.room")).alias("executors")
    )


def allocate_min_qos(
    nodes: DataFrame,
    target_ms: Column,
    limit: Column,
    adjust: Column | None = None,
    scope: Sequence[str] = ("job", "tick"),
    delta_s: float = 0.0,
) -> DataFrame:
    """Fewest executors that meet the latency target; NULL where none do.

    A solution of exactly ``limit`` executors does not count.
    """
    staged = nodes.withColumns({
        "_limit": limit, "_target": target_ms, "_adjust": adjust if adjust is not None else F.lit(1.0)
    })
    curves = _curves(_floors(staged, F.col("_limit") - 1, scope), scope, ("mmk",))
    facts = [*_qos_facts(), F.first("node._target").alias("_target"), F.first("node._adjust").alias("_adjust")]
    goals = _per_scope(curves, scope, [_qos_goal(F.col("_target"), F.col("_adjust"), delta_s)], facts)
    return steps_taken(curves, goals, scope, ("mmk",)).select(
        *scope, "component", "node.min_executors", _executors(F.col("node.room")).alias("executors")
    )


def broken_nodes(
    nodes: DataFrame, top: Column, scope: Sequence[str] = ("job", "tick"), longest: int = LONGEST_CURVE
) -> DataFrame:
    """Nodes whose counts, up to ``top`` executors of the job, reach ``longest``.

    At the default their jobs get no allocation: the rows are there, with NULL executors.
    """
    floors = _floors(nodes, top, scope)
    return floors.filter(broken(F.col("min_executors"), F.col("room"), longest)).select(*nodes.columns, "min_executors", "room")


OBJECTIVES = ("current", "max", "min_qos")


def top_executors() -> Column:
    """The most executors that any objective of :func:`check_optimized` can give a job's services."""
    return F.greatest(F.col("current_budget"), F.col("max_budget"), F.col("max_budget") * 2 - 1)


def check_optimized(
    nodes: DataFrame, qos_ms: float, scope: Sequence[str] = ("job", "tick"), model: str = "mmk"
) -> DataFrame:
    """All three objectives of every job from one set of gain curves.

    ``nodes`` carry their current ``executors``, and per scope ``real_ms``,
    ``current_budget`` and ``max_budget``. Result: one row per service and
    objective, with the status and the calibration context. The latency target
    is always searched with the M/M/k curves; the other two follow ``model``.
    """
    scope = list(scope)
    per_scope = Window.partitionBy(*scope)
    ranking = ("mmk",) if model == "mmk" else ("mmk", model)
    estimated = with_sojourn(spread(nodes, *scope), model, "_now").select(
        *nodes.columns,
        (F.sum(visit_time(F.col("_now"))).over(per_scope) * 1000.0).alias("_est_ms"),
        F.bool_and(node_stable()).over(per_scope).alias("network_stable"),
    )
    ratio, error = calibrate(F.col("real_ms"), F.col("_est_ms"))
    staged = estimated.select(
        *nodes.columns, "network_stable",
        F.when(F.col("_est_ms") < q.INFINITY, F.col("_est_ms")).alias("est_ms"),
        ratio.alias("ratio_real"), error.alias("error_pct"),
    )
    curves = _curves(_floors(staged, top_executors(), scope), scope, ranking)
    facts = [
        *_qos_facts(), F.first("node.ratio_real").alias("_ratio"),
        (F.first("node.current_budget") - F.first("node.floor_total")).alias("_current"),
        (F.first("node.max_budget") - F.first("node.floor_total")).alias("_max"),
    ]
    goals = _per_scope(curves, scope, [
        _goal("current", model, steps=F.col("_current")), _goal("max", model, steps=F.col("_max")),
        _qos_goal(F.lit(float(qos_ms)), F.col("_ratio"), 0.0),
    ], facts)
    # the latency goal has a limit of its own
    room = F.col("node.max_budget") * 2 - 1 - F.col("node.floor_total")
    found = steps_taken(curves, goals, scope, ranking).withColumn("_given", _executors(room))
    carried = [c for c in ("executors", "sources") if c in nodes.columns]
    kept = ["real_ms", "est_ms", "ratio_real", "error_pct", "network_stable"]
    wide = found.groupBy(*scope, "component").agg(
        *[F.first(f"node.{c}").alias(c) for c in kept],
        *[F.first(f"node.{c}").alias(f"_{c}") for c in carried],
        *[F.max(F.when(F.col("goal") == o, F.col("_given"))).alias(f"_{o}") for o in OBJECTIVES],
    )
    objectives = F.explode(F.array(*[
        F.struct(F.lit(o).alias("objective"), F.col(f"_{o}").alias("executors")) for o in OBJECTIVES
    ])).alias("_o")
    status = F.when(F.col("_min_qos").isNotNull(), F.lit("FEASIBLE")).otherwise(F.lit("INFEASIBLE"))
    return wide.select(
        *scope, "component", *[F.col(f"_{c}").alias({"executors": "current"}.get(c, c)) for c in carried],
        status.alias("status"), *kept[:-1], F.col("network_stable").alias("stable"), objectives,
    ).select("*", "_o.objective", "_o.executors").drop("_o")
