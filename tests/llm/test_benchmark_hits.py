from __future__ import annotations

import re
from hashlib import sha256

from tidegauge.llm import benchmark_hits

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def literal(docs, items, window=10):
    out = []
    for doc, text in docs:
        found, hit, owners = words(text), set(), set()
        for item, body in items:
            own = words(body)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i : i + window]
                for j in range(len(found) - len(part) + 1):
                    if found[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        owners |= {str(item)} - {"None"}
        digest = sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(owners), digest, bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two THREE four, five six seven eight nine ten eleven!"), (2, "tiny item"), (3, None), (4, "?!"), (12, "Tiny, ITEM"),
         (None, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (2, "tiny item")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, part string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_messy_rows(spark, messy, no_docs):
    short = messy.filter("doc_id is null or doc_id <> 6")
    extra = spark.createDataFrame([(20, "a tiny-item; one two three four five six seven eight nine ten eleven TINY item"),
                                   (21, "é tiny itemé x"), (22, "xtiny item")], "doc_id long, text string")
    docs = short.select("doc_id", "text").union(extra)
    assert found(benchmark_hits.contamination(docs, items(spark))) == literal([tuple(r) for r in docs.collect()], ITEMS)
    assert benchmark_hits.contamination(no_docs, items(spark)).count() == 0
    none = benchmark_hits.contamination(messy, items(spark, [])).collect()
    assert len(none) == messy.count() and not any(r["contaminated"] for r in none)
    long = benchmark_hits.contamination(messy.filter("doc_id = 6"), items(spark)).first()
    assert (long["n_words"], long["n_hit"], long["n_items"]) == (300_000, 300_000, 0)


def test_many_parts_and_passes_find_the_same(spark, documents, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    want = sorted(map(str, benchmark_hits.find_hits(documents, benchmark, "h").select("doc_id", "h").collect()))
    got = benchmark_hits.find_hits(documents, benchmark, "h", part_bytes=1000, broadcast_bytes=4000)
    unordered = [str(r).replace("\n", " ") for r in got.select("doc_id", "h.n_words", "h.ranges", "h.items").collect()]
    one = benchmark_hits.find_hits(documents, benchmark, "h").select("doc_id", "h.n_words", "h.ranges", "h.items").collect()
    assert sorted(unordered) == sorted(str(r).replace("\n", " ") for r in one) and len(want) == documents.count()


def test_spans_point_to_the_original(spark):
    text = "Ünï — One two THREE four,\nfive six seven eight nine ten eleven!! rest; Tiny ITEM."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hits = benchmark_hits.find_hits(docs, items(spark), "found").first()["found"]
    assert [text[s["begin"] : s["end"]] for s in hits["spans"]] == [
        "One two THREE four,\nfive six seven eight nine ten eleven", "Tiny ITEM"
    ]


def test_drop_contaminated(spark, messy):
    kept = benchmark_hits.drop_contaminated(messy, items(spark))
    assert kept.schema == messy.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 7, 8, 9, 10]


def test_query_equals_brute_force(spark, documents, data):
    benchmark = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    some = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = found(benchmark_hits.contamination(documents, spark.read.parquet(f"{data}/benchmark.parquet")))
    # strings between spaces are as good as lists of words here, and quick enough for whole texts
    lines = {i: b" " + b" ".join(words(t)) + b" " for i, t in some}
    windows = {}
    for item, text in benchmark:
        own = words(text)
        for i in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(b" " + b" ".join(own[i : i + 10]) + b" ", set()).add(str(item))
    suspects = {i for i, line in lines.items() if any(w in line for w in windows)}
    assert {r[0] for r in got if r[5]} == suspects and suspects
    want = {r[0]: r for r in literal([(i, t) for i, t in some if i in suspects], benchmark)}
    assert [r for r in got if r[5]] == sorted(want.values(), key=repr)
    assert all(r[1] == lines[r[0]].count(b" ") - 1 or not words(dict(some)[r[0]]) for r in got)
