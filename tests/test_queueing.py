from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import queueing as q
from tidegauge.operators import allocate, capacity

ERLANG = [
    (8, 10, 1, 0.4), (15, 10, 2, 0.128571429), (15, 10, 3, 0.015789474), (18.75, 15, 2, 0.042735043),
    (50, 20, 3, 0.070224719), (96, 10, 12, 0.015368396), (160, 10, 20, 0.006401945),
]
NODE = "job string, tick int, component string, lam double, mu double, ca2 double, cs2 double, ratio double"


def one(spark, lam, mu, k, expr, ca2=1.0, cs2=1.0):
    row = spark.createDataFrame([(float(lam), float(mu), int(k), float(ca2), float(cs2))],
                                "lam double, mu double, k int, ca2 double, cs2 double")
    return row.select(expr.alias("x")).first().x


LAM = MU = K = CA2 = CS2 = None


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns need a running session."""
    globals().update({c.upper(): F.col(c) for c in ("lam", "mu", "k", "ca2", "cs2")})


@pytest.mark.parametrize("lam,mu,k,want", ERLANG)
def test_erlang_table(spark, lam, mu, k, want):
    assert one(spark, lam, mu, k, q.erlang_wait(LAM, MU, K)) == pytest.approx(want, abs=1e-9)


def test_one_server_is_mm1(spark):
    wait = one(spark, 7, 11, 1, q.erlang_wait(LAM, MU, K))
    assert wait + 1 / 11 == pytest.approx(one(spark, 7, 11, 1, q.sojourn_mm1(LAM, MU)))


def test_unstable_and_idle(spark):
    assert one(spark, 30, 10, 3, q.erlang_wait(LAM, MU, K)) == math.inf
    assert one(spark, 31, 10, 3, q.erlang_wait(LAM, MU, K)) == math.inf
    assert one(spark, 0, 10, 3, q.erlang_wait(LAM, MU, K)) == 0.0
    assert one(spark, 5, 0, 3, q.utilisation(LAM, MU, K)) == q.UNDEFINED
    assert one(spark, 5, 5, 0, q.utilisation(LAM, MU, K)) == q.UNDEFINED
    assert one(spark, 10, 10, 1, q.sojourn_mm1(LAM, MU)) is None


def test_min_servers_is_strict(spark):
    assert one(spark, 30, 10, 1, q.min_servers(LAM, MU)) == 4
    assert one(spark, 29.9, 10, 1, q.min_servers(LAM, MU)) == 3
    assert one(spark, 0, 10, 1, q.min_servers(LAM, MU)) == 1


def test_curve_equals_single_counts(spark):
    nodes = spark.createDataFrame([("j", 1, "a", 42.0, 10.0, 1.0, 0.5, 1.0)], NODE)
    curve = capacity.capacity_curve(nodes, F.lit(5), F.lit(60), list(q.MODELS))
    direct = curve.select("*", q.erlang_wait(LAM, MU, K).alias("direct")).collect()
    assert [r.k for r in sorted(direct, key=lambda r: r.k)] == list(range(5, 61))
    assert all(r.wait_s == pytest.approx(r.direct, rel=1e-12) for r in direct)


# (ca2, cs2, lam, mu, k) -> sojourn seconds, worked out once outside Spark
COMPLEX = [
    (1, 1, 8, 10, 1, 0.5),
    (1, 1, 50, 20, 3, 0.120224719),
    (1, 1, 96, 10, 12, 0.115368396),
    (1, 0.4, 8, 10, 1, 0.378128437),
    (1, 0.4, 50, 20, 3, 0.099612379),
    (1, 0.4, 96, 10, 12, 0.111378512),
    (1, 2.5, 8, 10, 1, 0.776972259),
    (1, 2.5, 50, 20, 3, 0.16779385),
    (1, 2.5, 96, 10, 12, 0.124332995),
    (0.2, 0.3, 8, 10, 1, 0.188303808),
    (0.2, 0.3, 50, 20, 3, 0.065199947),
    (0.2, 0.3, 96, 10, 12, 0.102784442),
    (0.5, 0, 8, 10, 1, 0.2),
    (0.5, 0, 50, 20, 3, 0.06790129),
    (0.5, 0, 96, 10, 12, 0.104172279),
]


@pytest.mark.parametrize("ca2,cs2,lam,mu,k,want", COMPLEX)
def test_general_models(spark, ca2, cs2, lam, mu, k, want):
    wait = q.erlang_wait(LAM, MU, K)
    plain = one(spark, lam, mu, k, wait)
    simple = one(spark, lam, mu, k, q.sojourn("ggk_simple", LAM, MU, K, CA2, CS2, wait), ca2, cs2)
    assert simple == pytest.approx(plain * (ca2 + cs2) / 2 + 1 / mu)
    full = one(spark, lam, mu, k, q.sojourn("ggk_complex", LAM, MU, K, CA2, CS2, wait), ca2, cs2)
    assert full == pytest.approx(want, abs=1e-9)


def test_complex_falls_back(spark):
    wait = q.erlang_wait(LAM, MU, K)
    assert one(spark, 0, 10, 2, q.sojourn("ggk_complex", LAM, MU, K, CA2, CS2, wait)) == pytest.approx(0.1)
    assert one(spark, 5, 10, 1, q.sojourn("ggk_complex", LAM, MU, K, CA2, CS2, wait), 0, 0) == pytest.approx(0.1)


def loop_nodes(spark, rate):
    return spark.createDataFrame(
        [("loop", 1, "A", rate, 10.0, 1.0, 1.0, 1.0), ("loop", 1, "B", 1.25 * rate, 15.0, 1.0, 1.0, 1.25)], NODE
    )


@pytest.mark.parametrize("rate", [5.0, 9.9, 10.0, 15.0, 18.0, 22.0])
def test_loop_example_golden(spark, rate):
    rows = allocate.allocate_greedy(loop_nodes(spark, rate), F.lit(5)).collect()
    assert {r.component: r.executors for r in rows} == {"A": 3, "B": 2}


def test_loop_example_infeasible(spark):
    rows = allocate.allocate_greedy(loop_nodes(spark, 24.0), F.lit(5)).collect()
    assert [r.executors for r in rows] == [None, None]


def test_loop_example_estimate(spark):
    nodes = loop_nodes(spark, 15.0).withColumn("executors", F.when(F.col("component") == "A", 3).otherwise(2))
    assert capacity.network_sojourn(nodes).first().est_s * 1000 == pytest.approx(252.5416, abs=1e-4)


def test_calibrate_guards(spark):
    rows = spark.createDataFrame(
        [(100.0, 50.0), (50.0, 100.0), (0.0, 10.0), (10.0, 0.0), (10.0, math.inf), (0.0, 0.0)], "r double, e double"
    )
    ratio, error = capacity.calibrate(F.col("r"), F.col("e"))
    got = [(r.a, r.b) for r in rows.select(ratio.alias("a"), error.alias("b")).collect()]
    assert got == [(2.0, 50.0), (1.0, 100.0), (1.0, None), (1.0, 100.0), (1.0, None), (1.0, None)]
