"""Queueing formulas as Spark columns.

Rates are per second, times in seconds. ``lam`` is the arrival rate of a
component, ``mu`` the service rate of one executor, ``k`` the executor count,
``ca2`` and ``cs2`` the squared coefficients of variation of inter-arrival and
service time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stands for "not defined" where no finite rate exists.
UNDEFINED = 1.7976931348623157e308
INFINITY = float("inf")
LARGEST_COUNT = 2**31 - 1


def utilisation(lam: Column, mu: Column, k: Column) -> Column:
    return F.when((mu > 0) & (k > 0), lam / (mu * k)).otherwise(F.lit(UNDEFINED))


def is_stable(lam: Column, mu: Column, k: Column) -> Column:
    return utilisation(lam, mu, k) < 1.0


def min_servers(lam: Column, mu: Column) -> Column:
    """Smallest executor count with utilisation strictly below one.

    Stops at the largest integer, so one broken rate cannot fail a whole run.
    """
    return (F.floor(F.least(lam / mu, F.lit(LARGEST_COUNT - 1.0))) + 1).cast("int")


def _erlang_b_step(load: Column, blocked: Column, i: Column) -> Column:
    return load * blocked / (i + load * blocked)


def erlang_b(load: Column, k: Column) -> Column:
    """Blocking probability of ``k`` servers by the usual one-step recursion."""
    servers = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(servers, F.lit(1.0), lambda b, i: _erlang_b_step(load, b, i))


CURVE_BLOCK = 32


def erlang_b_curve(load: Column, lo: Column, hi: Column) -> Column:
    """Blocking probabilities for every count from ``lo`` to ``hi``, as one array.

    The recursion runs on from the first count of one block to that of the next,
    and inside a block each count continues from the block's first. So a curve
    of n points costs a fixed number of steps for each, and the array that grows
    while it is built holds one number per block only.
    """
    none = F.expr("cast(array() as array<int>)")
    size = F.lit(CURVE_BLOCK)
    length = F.greatest(hi - lo, F.lit(0))
    blocks = F.floor(length / size).cast("int")

    def on(blocked: Column, first: Column, steps: Column) -> Column:
        counts = F.when(steps > 0, F.sequence(first + 1, first + steps)).otherwise(none)
        return F.aggregate(counts, blocked, lambda b, i: _erlang_b_step(load, b, i))

    starts = F.aggregate(
        F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(none),
        F.array(erlang_b(load, lo)),
        lambda acc, j: F.concat(acc, F.array(on(F.element_at(acc, -1), lo + j * size, size))),
    )
    return F.flatten(F.transform(starts, lambda b, j: F.transform(
        F.sequence(F.lit(0), F.least(size - 1, length - j * size)), lambda s: on(b, lo + j * size, s)
    )))


def wait_from_blocking(lam: Column, mu: Column, k: Column, blocked: Column) -> Column:
    """Mean wait in queue of an M/M/k station from its blocking probability."""
    rho = utilisation(lam, mu, k)
    delayed = blocked / (1 - rho * (1 - blocked))
    return (
        F.when(lam <= 0, F.lit(0.0))
        .when(rho < 1.0, delayed / (k * mu - lam))
        .otherwise(F.lit(INFINITY))
    )


def erlang_wait(lam: Column, mu: Column, k: Column) -> Column:
    return wait_from_blocking(lam, mu, k, erlang_b(lam / mu, k))


def simple_correction(lam: Column, mu: Column, k: Column, ca2: Column, cs2: Column) -> Column:
    """Half the summed variability: one for exponential arrivals and services."""
    return (ca2 + cs2) / 2


def complex_correction(lam: Column, mu: Column, k: Column, ca2: Column, cs2: Column) -> Column:
    """Variability times the published multi-server correction factor.

    Falls back to the simple correction where the factor is undefined.
    """
    servers = k.cast("double")
    rho = utilisation(lam, mu, k)
    slack = 1 - rho
    # least() skips NULL, so an idle station passes here and falls back at the end
    gamma = F.least(
        F.try_divide(slack * (servers - 1) * (F.sqrt(4 + 5 * servers) - 2), 16 * servers * rho), F.lit(0.24)
    )
    busy = 1 + gamma
    light = (1 - 4 * gamma) * F.exp(F.try_divide(-2 * slack, 3 * rho))
    variability = (ca2 + cs2) / 2
    psi = F.when(variability < 1, F.pow(F.least((busy + light) / 2, F.lit(1.0)), 2 - 2 * variability)).otherwise(1.0)
    regular_service = (
        F.try_divide(busy * (ca2 - cs2), ca2 - 0.75 * cs2)
        + F.try_divide(psi * cs2, 4 * ca2 - 3 * cs2)
    )
    regular_arrival = (
        F.try_divide(light * (cs2 - ca2) / 2, ca2 + cs2)
        + F.try_divide(psi * (cs2 + 3 * ca2) / 2, ca2 + cs2)
    )
    factor = F.when(rho > 0, F.when(ca2 >= cs2, regular_service).otherwise(regular_arrival))
    return variability * F.coalesce(factor, F.lit(1.0))


def no_correction(lam: Column, mu: Column, k: Column, ca2: Column, cs2: Column) -> Column:
    return F.lit(1.0)


# A model is the factor it puts on the M/M/k wait. Add an entry to plug in another.
MODELS: dict[str, Callable[[Column, Column, Column, Column, Column], Column]] = {
    "mmk": no_correction,
    "ggk_simple": simple_correction,
    "ggk_complex": complex_correction,
}


def sojourn(model: str, lam: Column, mu: Column, k: Column, ca2: Column, cs2: Column, wait: Column) -> Column:
    """Wait under ``model`` plus one service time, given the M/M/k ``wait``."""
    factor = F.coalesce(MODELS[model](lam, mu, k, ca2, cs2), F.lit(1.0))
    # 0 * infinity is not a number: a station without queue or without capacity keeps its wait
    queued = F.when((wait > 0) & (wait < INFINITY), wait * factor).otherwise(wait)
    return queued + 1 / mu


def sojourn_mm1(lam: Column, mu: Column) -> Column:
    return F.try_divide(F.lit(1.0), mu - lam)
