from __future__ import annotations

import numpy as np
import pytest

from tidegauge.llm import collision_search


def literal(rows, k, every):
    """Brute force over ``(id, vector)`` rows."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scored = [
                (-float(good[q] @ v / (np.sqrt(v @ v) * np.sqrt(good[q] @ good[q]))), i)
                for i, v in good.items() if i != q and len(v) == len(good[q])
            ]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [4096, 150])
def test_recall_and_exact_scores(spark, data, block):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    want = literal([(r["vec_id"], r["embedding"]) for r in table.collect()], 5, 50)
    got = found(collision_search.neighbours(table, block=block))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    exact = {(q, i): s for q, near in literal([(r["vec_id"], r["embedding"]) for r in table.collect()], 10**6, 50).items() for i, s in near}
    assert all(s == pytest.approx(exact[q, i], abs=1e-11) for q, near in got.items() for i, s in near)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]),
            (150, [3.0, 2.0, 1.0]), (1, [1.0, 0.0]), (-50, [-1.0, 0.0]), (200, [5.0])]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, point string, score double")
    want = literal(dict(r for r in rows if r[0] is not None).items(), 5, 50)
    got = found(collision_search.neighbours(table))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert collision_search.neighbours(table.limit(0)).count() == 0


def test_a_third_of_the_rows_are_one_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 900, 3)]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(900) if i % 3]
    got = found(collision_search.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [i for i, _ in got[300]] == [0, 3, 6, 9, 12] and [i for i, _ in got[0]] == [3, 6, 9, 12, 15]
    assert len(got) == 18


def test_windows_widen_until_enough_is_found():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(500, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    block = collision_search.Block(units, 96)
    few, many = block.collide(units[0], 5), block.collide(units[0], 200)
    assert 0 in few and 5 <= few.size <= many.size and many.size >= 200
    assert block.collide(units[0], 10**9).size == 500


def test_several_full_blocks_stop_early_and_find_nine_tenths(spark, monkeypatch):
    """Unrelated directions with some near ones each, as in the given table, in three blocks that are as full as a block gets."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4000, 64))
    vectors = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0.9, 1.1, 1.3)])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = found(collision_search.neighbours(table, every=100))
    asked = np.arange(0, len(vectors), 100)
    cosine = vectors[asked] @ vectors.T
    cosine[np.arange(asked.size), asked] = -2
    want = np.argsort(-cosine, axis=1)[:, :5]
    hits = sum(len({i for i, _ in got[int(q)]} & set(near.tolist())) for q, near in zip(asked, want))
    assert hits >= 0.9 * want.size and all(len(v) == 5 for v in got.values())
    block = collision_search.Block(vectors[: collision_search.BLOCK], collision_search.LINES)
    verified = [block.collide(vectors[q], 6 * collision_search.ENOUGH).size for q in asked]
    assert max(verified) < collision_search.BLOCK and np.mean(verified) < 0.5 * collision_search.BLOCK


def test_finite_extremes_have_finite_cosines(spark):
    rows = [(0, [2.0**600, 0.0]), (1, [2.0**-600, 0.0]), (2, [3.0, 4.0]), (3, [5e-324, 5e-324]), (50, [2.0**1023, 2.0**1023]), (5, [-1e300, 1e-300])]
    got = found(collision_search.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[0] == [(1, 1.0), (3, pytest.approx(0.5**0.5)), (50, pytest.approx(0.5**0.5)), (2, pytest.approx(0.6)), (5, -1.0)]
    assert [i for i, _ in got[50]] == [3, 2, 0, 1, 5] and got[50][0][1] == pytest.approx(1.0)


def test_scaling_changes_no_cosine():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(50, 8)) * 10.0 ** rng.integers(-3, 4, size=(50, 1))
    s = collision_search.scaled(v)
    assert ((np.abs(s).max(axis=1) >= 0.5) & (np.abs(s).max(axis=1) < 1)).all()
    def cosines(x):
        return (x @ x[0]) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[0] * x[0]).sum()))
    assert (cosines(v) == cosines(s)).all()
