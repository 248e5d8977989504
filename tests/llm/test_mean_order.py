"""Clusters against plain loops over Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tidegauge.llm import mean_order

NAN, INF = float("nan"), float("inf")


def literal(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centroids, members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 8, 200])
def test_nearest_equals_all_distances(k):
    random = np.random.default_rng(k)
    centroids = random.integers(-40, 40, (k, 6))
    centroids[k // 2 :] = centroids[: k - k // 2]
    x = np.concatenate([random.integers(-60, 60, (3000, 6)), centroids, centroids[:, ::-1]])
    order = mean_order.MeanOrder(centroids)
    who, distance = order.nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (distance == every.min(1)).all()
    # the inequalities do reject: far fewer exact distances than pairs
    assert k < 200 or order.evaluated < 0.5 * every.size


def test_bounds_hold_at_the_largest_components():
    random = np.random.default_rng(5)
    limit = 1 << 27
    x = random.integers(-limit, limit + 1, (400, 64))
    centroids = np.concatenate([x[:50], x[:50] + 1 - 2 * (x[:50] > 0)])
    who, distance = mean_order.MeanOrder(centroids).nearest(x)
    for row, w, d in zip(x[:80], who, distance):
        every = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, c)) for c in centroids]
        assert d == min(every) and w == every.index(min(every))


def test_whole_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert got(mean_order.cluster(table)) == sorted(literal(rows, 8, 10, 64, 1024), key=repr)


def test_messy_vectors(spark):
    rows = [(0, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [1.0, 3.0]), (3, None), (4, []), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, None]),
            (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (2, [1.0, 3.0]), (2, [-7.0, 3.001]), (9, [0.0, 0.0]), (10, [-0.0, 1e-300]), (11, [-1e-300, 5.0])]
    clash = ["x", "cluster", "distance", "inertia", "h"]
    table = spark.createDataFrame([(*r, *clash) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in clash))
    for k in (1, 3, 40):
        assert got(mean_order.cluster(table, k, 3, 2)) == sorted(literal(rows, k, 3, 2, 1024), key=repr)
    nothing = mean_order.cluster(table.limit(0))
    assert nothing.count() == 0 and nothing.columns == mean_order.cluster(table, 3, 1, 2).columns
    nameless = mean_order.cluster(table.filter("vec_id IS NULL"), 3, 1, 2).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 6]


def test_centroids_without_members_stay(spark):
    rows = [(i, [float(i % 2)]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(mean_order.cluster(table, 6, 4, 1)) == sorted(literal(rows, 6, 4, 1, 1024), key=repr)


def test_components_beyond_a_long_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        mean_order.cluster(table, 1, 1, 1).collect()
