"""Gain curves, the search for the threshold, and what it unfolds."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F
from test_allocation import NODE, by_job, digits, greedy, min_qos, sojourn

from tidegauge.operators import allocate, gains

SCOPE = ["job", "tick"]


def table(spark, nodes):
    names = [c.split()[0] for c in NODE.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODE)


def node(component, lam, mu, budget, cs2=1.0, ratio=1.0, job="j", target=1.0, adjust=1.0, bound=10):
    return dict(job=job, tick=1, component=component, lam=lam, mu=mu, ca2=1.0, cs2=cs2, ratio=ratio, budget=budget,
                target=target, adjust=adjust, bound=bound)


class Curve:
    """Times of one station for rising counts, each from the one before."""

    def __init__(self, n):
        self.n, self.k, self.b, self.load = n, 0, 1.0, n["lam"] / n["mu"]
        self.floor = int(self.load) + 1
        self.times = []

    def at(self, k):
        while self.floor + len(self.times) <= k:
            while self.k < self.floor + len(self.times):
                self.k += 1
                self.b = self.load * self.b / (self.k + self.load * self.b)
            rho = self.n["lam"] / (self.n["mu"] * self.k)
            wait = self.b / (1 - rho * (1 - self.b)) / (self.k * self.n["mu"] - self.n["lam"])
            self.times.append(wait + 1 / self.n["mu"])
        return self.times[k - self.floor]

    def gain(self, k):
        return digits((self.at(k) - self.at(k + 1)) * self.n["ratio"])


def merged(nodes, budget):
    """One executor at a time, the next one always from the largest gain; ties by name."""
    curves = {n["component"]: Curve(n) for n in nodes}
    held = {c: v.floor for c, v in curves.items()}
    heads = [(-v.gain(v.floor), c) for c, v in curves.items()]
    heapq.heapify(heads)
    for _ in range(budget - sum(held.values())):
        _, c = heapq.heappop(heads)
        held[c] += 1
        heapq.heappush(heads, (-curves[c].gain(held[c]), c))
    return held


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 4096, 4097, 9000])
def test_running_min(spark, size):
    rng = random.Random(size)
    values = [rng.uniform(-5, 5) - i / 500 for i in range(size)]
    got = spark.createDataFrame([(values,)], "x array<double>").select(gains.running_min(F.col("x"))).first()[0]
    low, want = float("inf"), []
    for v in values:
        low = min(low, v)
        want.append(low)
    assert got == want


def test_count_above(spark):
    heads = [5.0, 5.0, 3.0, 3.0, 3.0, 0.0, 0.0, -0.5]
    asked = [(heads, t) for t in (9.0, 5.0, 4.0, 3.0, 1.0, 0.0, -0.1, -0.5, -1.0)] + [([], 0.0)]
    got = [r[0] for r in spark.createDataFrame(asked, "h array<double>, t double").coalesce(1).select(
        gains.count_above(F.col("h"), F.col("t"))).collect()]
    assert got == [sum(h > t for h in hs) for hs, t in asked]


@pytest.fixture(scope="module")
def large():
    """Five hundred components of one job, rates over seven decades, and twins."""
    rng = random.Random(3)
    out = []
    for i in range(500):
        if i % 5 == 4:
            out.append(dict(out[-1], component=f"c{i:03d}"))
            continue
        mu = 10 ** rng.uniform(0, 7)
        out.append(node(f"c{i:03d}", mu * rng.choice([0.3, 0.9, 2.5, 7.2, 30.5]), mu, 8000, ratio=rng.choice([0.5, 1.0, 2.0])))
    return out


def test_budget_of_thousands_unfolds_few_rows(spark, large):
    df = table(spark, large)
    curves = allocate._curves(allocate._floors(df, F.col("budget"), SCOPE), SCOPE, ("mmk",))
    goals = allocate._per_scope(curves, SCOPE, [allocate._goal("budget", "mmk", steps=F.col("_room"))], [F.first("node.room").alias("_room")])
    found = gains.brackets(curves, goals, SCOPE, ("mmk",))
    rows = gains.bracket_steps(curves, found, SCOPE, ("mmk",))
    assert rows.count() <= gains.PER_COMPONENT * 500 + gains.AT_ALL + 500
    state = found.first()
    assert state.high.n < state.steps <= state.low.n
    got = by_job(allocate.allocate_greedy(df, "budget").collect())["j"]
    assert sum(got.values()) == 8000 and got == merged(large, 8000)


@pytest.fixture
def narrow_brackets(monkeypatch):
    """Brackets as narrow as those of a large job, so that small ones are searched as well."""
    monkeypatch.setattr(gains, "AT_ALL", 0)


def test_more_executors_than_gain(spark, narrow_brackets):
    """Beyond some count nothing is gained any more: the rest goes by name, in one run of equal steps."""
    nodes = [node(c, 3.0, 10.0, 400) for c in "abc"] + [node("d", 0.0, 10.0, 400)]
    got = by_job(allocate.allocate_greedy(table(spark, nodes), "budget").collect())["j"]
    assert got == greedy(nodes, 400) and sum(got.values()) == 400


def test_all_equal_components(spark, narrow_brackets):
    nodes = [node(f"c{i:02d}", 25.0, 10.0, 211) for i in range(40)]
    got = by_job(allocate.allocate_greedy(table(spark, nodes), "budget").collect())["j"]
    assert got == greedy(nodes, 211)


@pytest.mark.parametrize("model", ["ggk_simple", "ggk_complex"])
def test_other_models_over_wide_rates(spark, model, narrow_brackets):
    rng = random.Random(5)
    nodes = [node(f"c{i}", mu * rng.choice([0.5, 3.3, 12.2]), mu, 160, cs2=rng.uniform(0, 3)) for i, mu in enumerate(10.0 ** rng.uniform(0, 4) for _ in range(12))]
    got = by_job(allocate.allocate_greedy(table(spark, nodes), "budget", model=model).collect())["j"]
    assert got == greedy(nodes, 160, model)


def test_latency_goal_with_many_steps(spark, narrow_brackets):
    rng = random.Random(8)
    nodes = []
    for j in range(6):
        mus = [rng.uniform(1, 50) for _ in range(30)]
        floor = sum(1 / m for m in mus)
        rows = [node(f"c{i:02d}", m * rng.choice([0.6, 2.9, 8.8]), m, 0, job=f"j{j}", target=1000 * floor * rng.choice([1.01, 1.1, 1.6]), bound=900)
                for i, m in enumerate(mus)]
        nodes += [dict(r, target=rows[0]["target"]) for r in rows]
    got = by_job(allocate.allocate_min_qos(table(spark, nodes), F.col("target"), F.col("bound")).collect())
    for j in range(6):
        own = [n for n in nodes if n["job"] == f"j{j}"]
        found, target = got[f"j{j}"], own[0]["target"] / 1000
        total = sum(found.values())
        assert found == merged(own, total)
        est = sum(sojourn(n, found[n["component"]], "mmk") * n["ratio"] for n in own)
        fewer = merged(own, total - 1)
        before = sum(sojourn(n, fewer[n["component"]], "mmk") * n["ratio"] for n in own)
        assert est <= target < before


def test_small_jobs_need_no_round_and_equal_the_loop(spark):
    nodes = [node("a", 15.0, 10.0, 6, target=300.0, bound=12), node("b", 18.0, 15.0, 6, target=300.0, bound=12)]
    got = by_job(allocate.allocate_min_qos(table(spark, nodes), F.col("target"), F.col("bound")).collect())["j"]
    assert got == min_qos(nodes, 300.0, 1.0, 12)


def test_broken_nodes_keep_their_rows_and_are_named(spark):
    nodes = [node("a", 1e6, 1e-9, 5, job="bad"), node("b", 1.0, 2.0, 5, job="bad"), node("a", 1.0, 2.0, 2_000_000, job="wide"),
             node("a", 8.0, 10.0, 3, job="good"), node("a", 50.0, 1.0, 3, job="small")]
    df = table(spark, nodes)
    got = {(r.job, r.component): r.executors for r in allocate.allocate_greedy(df, "budget").collect()}
    assert got == {("bad", "a"): None, ("bad", "b"): None, ("wide", "a"): None, ("good", "a"): 3, ("small", "a"): None}
    named = allocate.broken_nodes(df, F.col("budget")).collect()
    assert {(r.job, r.component) for r in named} == {("bad", "a"), ("wide", "a")}
