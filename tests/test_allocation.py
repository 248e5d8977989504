"""The ranked allocation against a literal one-at-a-time loop."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import allocate

NODE = ("job string, tick int, component string, lam double, mu double, ca2 double, cs2 double, ratio double, "
        "budget int, target double, adjust double, bound int")


def wait(lam, mu, k):
    if lam <= 0:
        return 0.0
    load, b = lam / mu, 1.0
    for i in range(1, k + 1):
        b = load * b / (i + load * b)
    rho = lam / (mu * k)
    return b / (1 - rho * (1 - b)) / (k * mu - lam) if rho < 1 else math.inf


def digits(gain):
    """Twelve significant digits, so that rounding noise does not break ties."""
    return float(f"{gain:.12g}") if math.isfinite(gain) else gain


def complex_factor(n, k):
    """The published multi-server correction (van Vliet and Rinnooy Kan)."""
    a, s, rho = n["ca2"], n["cs2"], n["lam"] / (n["mu"] * k)
    g = min(0.24, (1 - rho) * (k - 1) * ((4 + 5 * k) ** 0.5 - 2) / (16 * k * rho))
    busy, light, v = 1 + g, (1 - 4 * g) * math.exp(-2 * (1 - rho) / (3 * rho)), (a + s) / 2
    psi = min(1.0, (busy + light) / 2) ** (2 - 2 * v) if v < 1 else 1.0
    if a >= s:
        return v * (busy * (a - s) / (a - 0.75 * s) + psi * s / (4 * a - 3 * s))
    return v * (light * (s - a) / 2 / (a + s) + psi * (s + 3 * a) / 2 / (a + s))


def sojourn(n, k, model):
    factor = (n["ca2"] + n["cs2"]) / 2 if model == "ggk_simple" else 1.0
    if model == "ggk_complex" and 0 < n["lam"] < n["mu"] * k:
        factor = complex_factor(n, k)
    return wait(n["lam"], n["mu"], k) * factor + 1 / n["mu"]


def greedy(nodes, budget, model="mmk"):
    held = {n["component"]: int(n["lam"] / n["mu"]) + 1 for n in nodes}
    left = budget - sum(held.values())
    if left < 0:
        return None
    for _ in range(left):
        best = None
        for n in sorted(nodes, key=lambda n: n["component"]):
            if n["lam"] <= 0:
                continue
            k = held[n["component"]]
            gain = digits((sojourn(n, k, model) - sojourn(n, k + 1, model)) * n["ratio"])
            if gain > -1 and (best is None or gain > best[0]):
                best = (gain, n["component"])
        if best is None:
            break
        held[best[1]] += 1
    return held


def min_qos(nodes, target_ms, adjust, limit):
    n = sum(int(x["lam"] / x["mu"]) + 1 for x in nodes)
    if not sum(1 / x["mu"] for x in nodes) * adjust < target_ms / 1000:
        return None
    while n + 1 <= limit:
        held = greedy(nodes, n)
        est = sum(sojourn(x, held[x["component"]], "mmk") * x["ratio"] for x in nodes)
        if est * adjust <= target_ms / 1000:
            return held
        n += 1
    return None


@pytest.fixture(scope="module")
def networks():
    rng = random.Random(7)
    jobs = {}
    for j in range(60):
        nodes = []
        budget = rng.randint(3, 30)
        shared = dict(budget=budget, target=rng.choice([150.0, 400.0, 900.0, 2000.0]),
                      adjust=rng.choice([1.0, 1.4, 2.0]), bound=2 * budget)
        twin = (rng.uniform(1, 40), rng.uniform(3, 20))
        for c in range(rng.randint(1, 5)):
            lam, mu = twin if rng.random() < 0.3 else (rng.uniform(1, 40), rng.uniform(3, 20))
            if rng.random() < 0.1:
                lam = 0.0
            nodes.append(dict(job=f"j{j:03d}", tick=1, component=f"c{c}", lam=lam, mu=mu, ca2=1.0,
                              cs2=rng.uniform(0, 3), ratio=rng.choice([0.0, 0.5, 1.0, 1.25, 2.0]), **shared))
        jobs[f"j{j:03d}"] = nodes
    return jobs


@pytest.fixture(scope="module")
def frame(spark, networks):
    rows = [tuple(n[c.split()[0]] for c in NODE.split(", ")) for nodes in networks.values() for n in nodes]
    return spark.createDataFrame(rows, NODE)


def by_job(rows):
    out = {}
    for r in rows:
        out.setdefault(r.job, {})[r.component] = r.executors
    return {j: None if None in a.values() else a for j, a in out.items()}


@pytest.mark.parametrize("model", ["mmk", "ggk_simple", "ggk_complex"])
def test_greedy_equals_loop(frame, networks, model):
    got = by_job(allocate.allocate_greedy(frame, "budget", model=model).collect())
    assert got == {j: greedy(n, n[0]["budget"], model) for j, n in networks.items()}
    assert None in got.values()


def test_tiny_gains_count_at_any_scale(spark):
    """Rates over seven decades and a large budget, against the loop without any rounding."""
    rows = [("j", 1, f"c{i}", 0.8 * mu, mu, 1.0, 1.0, 1.0, 60, 100.0, 1.0, 120) for i, mu in enumerate((1e4, 10.0, 11.0, 1e7))]
    rows += [("k", 1, f"c{i}", 0.7 * mu, mu, 1.0, 1.0, 1.0, 1500, 100.0, 1.0, 120) for i, mu in enumerate((1.0, 1e3, 1e6))]
    names = [c.split()[0] for c in NODE.split(", ")]
    got = by_job(allocate.allocate_greedy(spark.createDataFrame(rows, NODE), "budget").collect())
    for job in ("j", "k"):
        nodes = [dict(zip(names, r)) for r in rows if r[0] == job]
        held = {n["component"]: 1 for n in nodes}
        curve = {n["component"]: [sojourn(n, k, "mmk") for k in range(1, 60)] for n in nodes}
        for _ in range(min(nodes[0]["budget"], 60) - len(nodes)):
            gains = {c: curve[c][k - 1] - curve[c][k] for c, k in held.items()}
            best = max(gains, key=gains.get)
            held[best] += 1
        if job == "j":
            assert got[job] == held
        assert sum(got[job].values()) <= nodes[0]["budget"] and min(got[job].values()) > 3


def test_min_qos_equals_loop(frame, networks):
    got = by_job(allocate.allocate_min_qos(frame, F.col("target"), F.col("bound"), F.col("adjust")).collect())
    want = {j: min_qos(n, n[0]["target"], n[0]["adjust"], n[0]["bound"]) for j, n in networks.items()}
    assert got == want
    assert None in got.values() and any(v is not None for v in got.values())


def test_best_gain_is_the_first_step(frame, networks):
    got = {r.job: r.component for r in allocate.best_gain(frame).collect()}
    for job, nodes in networks.items():
        floor = greedy(nodes, sum(int(n["lam"] / n["mu"]) + 1 for n in nodes))
        after = greedy(nodes, sum(floor.values()) + 1)
        grown = [c for c in floor if after[c] != floor[c]]
        assert ([got[job]] if job in got else []) == grown


def test_one_broken_rate_does_not_fail_the_run(spark):
    rows = [("bad", 1, "a", 1e6, 1e-9, 1.0, 1.0, 1.0, 5, 100.0, 1.0, 10), ("bad", 1, "b", 1.0, 2.0, 1.0, 1.0, 1.0, 5, 100.0, 1.0, 10),
            ("good", 1, "a", 8.0, 10.0, 1.0, 1.0, 1.0, 3, 200.0, 1.0, 6)]
    df = spark.createDataFrame(rows, NODE)
    assert by_job(allocate.allocate_greedy(df, "budget").collect()) == {"bad": None, "good": {"a": 3}}
    got = by_job(allocate.allocate_min_qos(df, F.col("target"), F.col("bound"), F.col("adjust")).collect())
    assert got["bad"] is None and got["good"] == {"a": 2}


def test_fixture_goldens(spark, data):
    """Whole period as one tick, all tuples completed: the documented allocations."""
    from tidegauge.catalog import datasets as d
    from tidegauge.operators import moments, topology
    from tidegauge.plans import optimise as plan
    from tidegauge.schemas import Params

    sf = data.replace("sf0.001", "sf0.01")
    events = d.tuple_events(spark, sf).withColumn("outcome", F.lit("ok"))
    totals = moments.component_totals(d.executor_reports(spark, sf, events).withColumn("tick", F.lit(1)))
    allocation = topology.allocation_counts(d.executors(spark, sf))
    params = Params(max_executors=22, qos_ms=450.0, interval_seconds=d.DAY, start=d.START)
    rows = plan.optimise(totals, allocation, params).collect()
    chosen = {}
    for r in sorted(rows, key=lambda r: r.component):
        if r.component != "view":
            chosen.setdefault((r.job, r.objective), []).append(r.executors)
    assert [chosen[f"job{j}", "max"] for j in range(4)] == [[5, 5, 4, 4], [5, 4, 4, 5], [4, 5, 4, 5], [5, 5, 4, 4]]
    assert [chosen[f"job{j}", "min_qos"] for j in range(4)] == [[4, 4, 4, 4], [4, 4, 4, 4], [4, 4, 3, 4], [4, 4, 3, 4]]
    context = {r.job: (r.est_ms, r.real_ms, r.ratio_real) for r in rows}
    assert context["job0"] == pytest.approx((243.956961, 412.936699, 1.692662), abs=1e-6)
    assert context["job3"] == pytest.approx((251.060752, 363.455512, 1.44768), abs=1e-6)
