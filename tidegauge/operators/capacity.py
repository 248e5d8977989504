"""Derived queueing table per component, and what-if capacity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import moments as m
from tidegauge.functions import queueing as q
from tidegauge.operators.gains import LONGEST_CURVE
from tidegauge.schemas import Params


def _mean(column: str) -> Column:
    return m.avg(F.col(f"{column}_cnt"), F.col(f"{column}_s"))


def _complete_rate(params: Params) -> Column:
    return F.try_divide(
        F.col("cnt") * F.col("executors"), F.col("duration_ms") / 1000.0 * F.lit(params.sample_rate)
    )


def _present(df: DataFrame) -> list[str]:
    keys = ("job", "epoch", "tick", "tick_in_epoch", "component", "executors")
    return [c for c in keys if c in df.columns]


def external_rate() -> Column:
    return _mean("recv_rate") * F.col("executors")


def real_ms() -> Column:
    return m.avg(F.col("cnt"), F.col("s"))


def source_nodes(history: DataFrame, params: Params) -> DataFrame:
    """Derived row per source; ``history`` carries the totals and ``executors``."""
    cnt, s, ss = F.col("cnt"), F.col("s"), F.col("ss")
    return history.filter(F.col("kind") == "source").select(
        *_present(history),
        real_ms().alias("real_ms"),
        m.scv(cnt, s, ss).alias("real_scv"),
        cnt.alias("completed"),
        (F.col("duration_ms") / 1000.0).alias("duration_seconds"),
        _complete_rate(params).alias("complete_rate"),
        # every emitted tuple is acknowledged once, so half of the send queue is emits
        (_mean("send_rate") * F.col("executors") / 2.0).alias("emit_rate"),
        external_rate().alias("external_rate"),
        _mean("send_population").alias("send_length"),
        _mean("recv_population").alias("recv_length"),
        F.lit(1.0).alias("emit_scv"),
        F.lit(1.0).alias("external_scv"),
    )


def attach_source_rate(services: DataFrame, sources: DataFrame, by: Sequence[str] = ("job", "tick")) -> DataFrame:
    """Give every service the external rate of its job's source.

    ``sources`` has one row per job (see ``pick_source``). Without one the rate
    is unknown and the visit ratio becomes zero.
    """
    rate = sources.select(*by, "external_rate")
    return services.join(rate, list(by), "left")


def _service_columns(params: Params) -> list[Column]:
    cnt, s, ss, e = F.col("cnt"), F.col("s"), F.col("ss"), F.col("executors")
    served = m.avg(cnt, s)
    lam = _mean("recv_rate") * e
    external = F.coalesce(F.col("external_rate"), F.lit(0.0))
    return [
        lam.alias("lam"),
        F.when(served > 0, 1000.0 / served).otherwise(F.lit(q.UNDEFINED)).alias("mu"),
        F.try_divide(lam * served, e * 1000.0).alias("rho"),
        F.when(external > 0, lam / external).otherwise(F.lit(0.0)).alias("ratio"),
        served.alias("service_ms"),
        m.scv(cnt, s, ss).alias("cs2"),
        F.lit(1.0).alias("ca2"),
        cnt.alias("completed"),
        (F.col("duration_ms") / 1000.0).alias("duration_seconds"),
        _complete_rate(params).alias("complete_rate"),
        _mean("send_population").alias("send_length"),
        _mean("recv_population").alias("recv_length"),
    ]


def service_nodes(
    history: DataFrame, sources: DataFrame, params: Params, by: Sequence[str] = ("job", "tick")
) -> DataFrame:
    """Derived row per service."""
    rated = attach_source_rate(history.filter(F.col("kind") != "source"), sources, by)
    return rated.select(*_present(history), *_service_columns(params))


def network_nodes(history: DataFrame, params: Params, scope: Sequence[str] = ("job", "tick")) -> DataFrame:
    """:func:`service_nodes` with what the optimiser needs from the rest of the job.

    The source's measurements, the executors in use and the list of sources come
    from windows over the scope, so the history is neither joined nor read twice.
    """
    per_scope = Window.partitionBy(*scope)
    source = F.col("kind") == "source"
    chosen = F.min(
        F.when(source, F.struct("component", external_rate().alias("rate"), real_ms().alias("real")))
    ).over(per_scope)
    held = F.struct("component", "executors")
    joined = history.select(
        "*",
        chosen.alias("_source"),
        F.collect_list(F.when(source, held)).over(per_scope).alias("sources"),
        F.sum(F.when(source, F.col("executors")).otherwise(0)).over(per_scope).cast("int").alias("source_executors"),
        F.sum(F.when(source, 0).otherwise(F.col("executors"))).over(per_scope).cast("int").alias("service_executors"),
    ).withColumn("external_rate", F.col("_source.rate"))
    return joined.filter(~source).select(
        *_present(history), *_service_columns(params),
        F.coalesce("_source.real", F.lit(0.0)).alias("real_ms"),
        F.array_sort("sources").alias("sources"), "source_executors", "service_executors",
    )


def with_sojourn(nodes: DataFrame, model: str, name: str, k: str = "executors") -> DataFrame:
    """Add the sojourn time of each node at its executor count."""
    lam, mu, count = F.col("lam"), F.col("mu"), F.col(k)
    wait = q.erlang_wait(lam, mu, count)
    return nodes.withColumn("_wait", wait).withColumn(
        name, q.sojourn(model, lam, mu, count, F.col("ca2"), F.col("cs2"), F.col("_wait"))
    ).drop("_wait")


def capacity_curve(nodes: DataFrame, lo: Column, hi: Column, models: Sequence[str] = ("mmk",)) -> DataFrame:
    """One row per node and executor count ``k`` from ``lo`` to ``hi``.

    Adds ``k, rho, stable, wait_s`` and one ``sojourn_<model>`` per model. A node
    whose counts reach :data:`LONGEST_CURVE` has a broken rate and no curve; see
    :func:`without_curve`.
    """
    lam, mu, k = F.col("lam"), F.col("mu"), F.col("k")
    kept = [c for c in nodes.columns if c not in ("rho", "stable")]
    curve = (
        nodes.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint"))
        .filter((F.col("_lo") < LONGEST_CURVE) & (F.col("_hi") < LONGEST_CURVE))
        .withColumn("_lo", F.col("_lo").cast("int")).withColumn("_hi", F.col("_hi").cast("int"))
        .select(*kept, "_lo", F.posexplode(q.erlang_b_curve(lam / mu, F.col("_lo"), F.col("_hi"))).alias("_offset", "_blocked"))
        .withColumn("k", F.col("_lo") + F.col("_offset"))
        .withColumns({
            "rho": q.utilisation(lam, mu, k),
            "stable": q.is_stable(lam, mu, k),
            "wait_s": q.wait_from_blocking(lam, mu, k, F.col("_blocked")),
        })
    )
    wait = F.col("wait_s")
    return curve.withColumns({
        f"sojourn_{model}": q.sojourn(model, lam, mu, k, F.col("ca2"), F.col("cs2"), wait) for model in models
    }).drop("_lo", "_offset", "_blocked")


def without_curve(nodes: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The nodes that :func:`capacity_curve` has no rows for."""
    reached = (lo.cast("bigint") >= LONGEST_CURVE) | (hi.cast("bigint") >= LONGEST_CURVE)
    return nodes.filter(F.coalesce(reached, F.lit(True)))


def with_gain(curve: DataFrame, scope: Sequence[str], model: str = "mmk") -> DataFrame:
    """Add what one more executor takes off the end-to-end time."""
    w = Window.partitionBy(*scope, "component").orderBy("k")
    here = F.col(f"sojourn_{model}")
    return curve.withColumn("gain", (here - F.lead(here).over(w)) * F.col("ratio"))


def visit_time(sojourn: Column) -> Column:
    """Part of a station in the end-to-end time; nothing if it is never visited."""
    return F.when(F.col("ratio") == 0, F.lit(0.0)).otherwise(sojourn * F.col("ratio"))


def node_stable() -> Column:
    return q.is_stable(F.col("lam"), F.col("mu"), F.col("executors"))


def network_sojourn(nodes: DataFrame, scope: Sequence[str] = ("job", "tick"), model: str = "mmk") -> DataFrame:
    """Expected end-to-end time in seconds at the current executor counts."""
    return with_sojourn(nodes, model, "_sojourn").groupBy(*scope).agg(
        F.sum(visit_time(F.col("_sojourn"))).alias("est_s"), F.bool_and(node_stable()).alias("stable")
    )


def calibrate(real_ms: Column, est_ms: Column) -> tuple[Column, Column]:
    """``(ratio, error_pct)``: how far the estimate lies below the measurement.

    An undefined ratio counts as one; its error is then NULL.
    """
    ratio = F.try_divide(real_ms, est_ms)
    defined = ratio.isNotNull() & ~F.isnan(ratio) & (ratio > 1.0)
    error = F.try_divide(F.abs(real_ms - est_ms) * 100.0, real_ms)
    finite = F.when(~F.isnan(error) & (error < q.INFINITY), error)
    return F.when(defined, ratio).otherwise(F.lit(1.0)), finite
