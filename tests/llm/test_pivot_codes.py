"""Codes against plain loops over Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tidegauge.llm import pivot_codes

NAN, INF = float("nan"), float("inf")


def literal(rows, rounds, parts, entries, scale):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted((r[0], r[2]) for r in kept if r[0] is not None and r[2] and len(r[2]) % parts == 0)
    width = len(whole[0][1])
    step = width // parts
    first = [v for _, v in whole if len(v) == width][:entries]
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for v in (r[2] for r in kept if len(r[2]) == width)]
    books = [[v[p * step : (p + 1) * step] for v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for c in cut:
                members[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else e for e, m in zip(books[p], members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, label, v in kept:
        found = [nearest(v[p * step : (p + 1) * step], books[p]) for p in range(parts)] if len(v) == width else None
        out.append((i, label, found and "".join(f"{e:02x}" for _, e in found), found and sum(d for d, _ in found)))
        if found:
            sums[label] = sums.get(label, 0) + out[-1][3]
    return [(i, code, error, sums.get(label), digest) for i, label, code, error in out]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("pivots", [1, 4])
def test_nearest_equals_all_distances(pivots):
    random = np.random.default_rng(pivots)
    book = random.integers(-60, 60, (64, 4))
    book[40:] = book[:24]
    x = np.concatenate([random.integers(-90, 90, (4000, 4)), book])
    anchors = pivot_codes.choose_pivots(book, pivots)
    search = pivot_codes.PivotSearch(book, anchors)
    who, distance = search.nearest(x, pivot_codes.pivot_distances(x, anchors).astype(np.float32).astype(float))
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (distance == every.min(1)).all()
    # the bounds do reject
    assert search.evaluated < (0.2 if pivots == 4 else 0.6) * every.size


def test_bounds_hold_at_the_largest_components():
    random = np.random.default_rng(3)
    limit = 1 << 27
    book = random.integers(-limit, limit + 1, (64, 4))
    x = np.concatenate([book + random.integers(-1, 2, book.shape), random.integers(-limit, limit + 1, (500, 4))])
    anchors = pivot_codes.choose_pivots(book)
    who, distance = pivot_codes.PivotSearch(book, anchors).nearest(x, pivot_codes.pivot_distances(x, anchors).astype(np.float32).astype(float))
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_pivots_lie_apart_and_are_entries():
    book = np.array([[0, 0], [1, 0], [50, 0], [0, 49], [1, 1]])
    assert pivot_codes.choose_pivots(book, 3).tolist() == [[0, 0], [50, 0], [0, 49]]
    assert len(pivot_codes.choose_pivots(book[:2], 4)) == 2


def test_whole_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    assert got(pivot_codes.encode(table)) == sorted(literal(rows, 2, 16, 64, 256), key=repr)


def test_messy_vectors(spark):
    rows = [(5, 1, [0.5, -0.5]), (1, None, [0.5, -0.5]), (2, 1, [1.0, 3.0]), (3, 1, None), (4, 1, []), (6, 2, [NAN, 1.0]), (7, 2, [INF, 1.0]),
            (8, 2, [1.0, None]), (9, None, [1.0, 2.0, 3.0]), (None, 2, [9.0, 9.0]), (2, 1, [1.0, 3.0]), (2, 3, [-7.0, 3.001]),
            (10, 4, [1.0, 2.0, 3.0, 4.0]), (0, 1, [1.0, 2.0, 3.0]), (11, None, [-1e-300, 5.0])]
    clash = ["code", "error", "x", "far", "_key", "n"]
    table = spark.createDataFrame(
        [(*r, *clash) for r in rows], "vec_id long, label int, embedding array<double>, " + ", ".join(f"{c} string" for c in clash)
    )
    for entries in (1, 3, 64):
        assert got(pivot_codes.encode(table, parts=2, entries=entries)) == sorted(literal(rows, 2, 2, entries, 256), key=repr)
    nothing = pivot_codes.encode(table.limit(0))
    assert nothing.count() == 0 and nothing.columns == pivot_codes.encode(table, parts=2).columns
    assert [tuple(r) for r in pivot_codes.encode(table.filter("vec_id IS NULL"), parts=2).collect()] == [(None,) * 5]


def test_a_third_of_the_rows_have_one_label(spark):
    random = np.random.default_rng(4)
    rows = [(i, 0 if i % 3 else i, random.normal(size=4).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(pivot_codes.encode(table, parts=2, entries=16)) == sorted(literal(rows, 2, 2, 16, 256), key=repr)


def test_components_beyond_a_long_are_refused(spark):
    table = spark.createDataFrame([(1, 1, [1e30, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        pivot_codes.encode(table, parts=2).collect()
