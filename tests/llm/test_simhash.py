from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tidegauge.llm import components as components_module
from tidegauge.llm import simhash
from tidegauge.llm.components import components
from tidegauge.session import written


def literal_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def literal_components(prints, bits=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_in_pieces_and_at_once():
    for text in (None, "", "one", "A b c", "a B c d e f g h", "x " * 3000, "the quick brown fox " * 50 + "é 日本"):
        assert simhash.fingerprint(text) == simhash.fingerprint(text, size=7) == literal_print(text)


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    masks = simhash.block_masks(4, 6)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a ^ b) & (m % 2**64) == 0 for m in masks)


def chain(rng, n):
    """Fingerprints with chains, dense groups and strangers."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for base in out[: n // 4]:
        near = base
        for _ in range(6):
            for bit in rng.sample(range(64), 4):
                near ^= 1 << bit
            out.append(near)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    return sorted(set(out))


def test_components_equal_brute_force_also_in_chunks(spark):
    prints = chain(random.Random(5), 120)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "id long, print long")
    want = dict(zip(signed, literal_components(prints)))
    for chunk in (2048, 16):
        got = simhash.print_components(rows, "print", "id", chunk=chunk).collect()
        assert {r["print"]: r["component_id"] for r in got} == want, chunk


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    centre = random.Random(1).getrandbits(62)
    group = {centre ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)}
    links = simhash.link_prints(spark.createDataFrame([(g,) for g in group], "print long"))
    assert links.count() <= len(group) * len(simhash.block_masks(4, 6))


def test_messy_rows(messy, no_docs):
    got = simhash.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[1]] == [1, 1] and by[2][0]["component_id"] == 1
    zero = [by[3][0], by[4][0], by[5][0]]
    assert {(r["fingerprint"], r["component_id"]) for r in zero} == {("0" * 16, 3)}
    assert by[9][0]["component_id"] == 8 and len(by[None]) == 2
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(messy, no_docs):
    kept = simhash.keep_one(messy)
    assert kept.schema == messy.schema
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)
    ]
    assert simhash.keep_one(no_docs).count() == 0


def test_query_equals_brute_force(documents):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(rows)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = [literal_print(texts[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in ids] == [ids[r] for r in literal_components(prints)]


def test_contraction(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 50)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node, root in got.items():
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert {got[x] for x in seen} == {root}
    assert 100 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("turn", [1, -1, 7])
def test_a_long_chain_needs_few_rounds(spark, monkeypatch, turn):
    """In id order, against it, and with ids in another order; taking the smallest id would need 399 rounds for the first."""
    rounds = []

    def counted(df, tag):
        rounds.append(tag)
        return written(df, tag)

    monkeypatch.setattr(components_module, "written", counted)
    ids = [(turn * i) % 401 for i in range(401)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert len(got) == 401 and len(set(got.values())) == 1
    assert rounds.count("labels") <= 10


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.getrandbits(40)}"
    return out


def literal_similar(texts, share=0.8, width=5):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_keep_one_similar_equals_brute_force_also_in_chunks(spark):
    """Pairs at 0.8 differ in about ten bits of 64; those just below it stay."""
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        words = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice([30, 120, 400]))]
        near = [edited(rng, words, max(1, len(words) * c // 1000)) for c in (8, 18, 20, 24, 30)]
        texts += [" ".join(w) for w in [words, *near]]
    base = [f"w{rng.getrandbits(30)}" for _ in range(200)]
    texts += [" ".join(edited(rng, base, 2)) for _ in range(60)]
    line = " same line again and again"
    texts += ["one two three four five six seven eight nine ten" + line * 3, "one two three four five six seven eight nine ten" + line * 90]
    texts += ["a b", "A  b", "a b c", "", None, " \n"]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(literal_similar(texts)))
    for options in ({}, {"chunk": 7}, {"sizes": 500}):
        got = simhash.keep_one_similar(docs, 0.8, 5, **options)
        assert got.schema == docs.schema and sorted(r["doc_id"] for r in got.collect()) == want, options
    assert len(want) < simhash.keep_one(docs).count()


def test_keep_one_similar_messy_rows(messy, no_docs):
    kept = simhash.keep_one_similar(messy, 0.8, 5)
    assert kept.schema == messy.schema
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)
    ]
    assert simhash.keep_one_similar(no_docs, 0.8, 5).count() == 0


def test_pivots_of_sets_discard_pairs_without_loss():
    """Forty families of copies in one unit: pivots leave few pairs of different families, and no link goes."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(8):
            own = base.copy()
            own[rng.random(base.size) < rng.choice([0.02, 0.1, 0.12])] += np.uint64(1 + rng.integers(1 << 40))
            sets.append(np.unique(own))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    own = [set(s.tolist()) for s in sets]

    def literal(pairs):
        forest = simhash.Forest(len(sets))
        for i, j in pairs:
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                forest.join(np.array([i]), np.array([j]))
        return forest.root.tolist()

    n = len(sets)
    counts = {}
    for pivots in (0, 32):
        roots, counts[pivots] = simhash.exact_links(sets, np.zeros(n, int), 0.8, pivots)
        assert roots.tolist() == literal((i, j) for i in range(n) for j in range(i))
    assert counts[32] < counts[0] / 2 < n * n / 4
    sides = np.where(np.arange(n) % 3 == 0, 1, 2)
    roots, _ = simhash.exact_links(sets, sides, 0.8)
    assert roots.tolist() == literal((i, j) for i in range(n) for j in range(i) if sides[i] != sides[j])


def test_a_large_loose_group_is_dealt_to_many_places(spark):
    rows = [(i, 10, 7) for i in range(2000)] + [(5000 + i, 3, 100 + i // 2) for i in range(100)] + [(9000, 1, 900)]
    grouped = spark.createDataFrame(rows, "digest long, size long, loose long")
    got = simhash.crowded_groups(grouped, 512, 4000).collect()
    assert sorted(r["digest"] for r in got) == [r[0] for r in rows[:-1]]
    assert {r["loose"]: r["chunks"] for r in got} == {7: 5} | {100 + i: 1 for i in range(50)}
    plan = simhash.crowded_groups(grouped, 512, 4000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "salt" in plan.split("Join Inner")[1].split("\n")[0]
