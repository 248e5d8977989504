"""Benchmark passages in documents, found by one Aho-Corasick pass.

Test questions and answers are normalised to lower-case words and cut into
windows of consecutive words; the windows are the patterns of an automaton over
the words of a document, joined by single spaces. Matches come with offsets in
the normalised text, which are mapped back to words and to the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.frames import free_name
from tidegauge.llm.words import plain_words
from tidegauge.session import written

WINDOW = 10
#: Bytes of test items in one automaton (some 150 MB of memory), and in one broadcast.
PART_BYTES = 256 << 10
BROADCAST_BYTES = 32 << 20
#: Bytes of texts that are searched for one part of the items after the other.
SEARCHED_BYTES = 64 << 20
# Bytes of a word after A-Z became a-z: 0-9, a-z, and all of non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    return plain_words((text or "").encode())


def windows(text: str | None, window: int) -> set[bytes]:
    """Windows of consecutive words, with a space at both ends; a shorter text is one window."""
    words = normalised(text)
    if not words:
        return set()
    return {b" %b " % b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def build(items: list[tuple[str | None, str | None]], window: int) -> ahocorasick.Automaton:
    """One automaton over the windows of ``(item_id, text)``; each carries its length in words and the items that have it."""
    having: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, window):
            having.setdefault(w, set()).update([] if item is None else [item])
    automaton = ahocorasick.Automaton()
    for w, owners in having.items():
        automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(owners)))
    if having:
        automaton.make_automaton()
    return automaton


def search(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of hit words (first, after last; merged), and the items found."""
    words = normalised(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = b" %b " % b" ".join(words)
    # the last character of a match is the space after its last word
    found = [(end, n, owners) for end, (_, n, owners) in automaton.iter(line.decode("latin-1"))]
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    after = np.searchsorted(spaces, [end for end, _, _ in found])
    ranges = merged([(int(e) - n, int(e)) for e, (_, n, _) in zip(after, found)])
    return len(words), ranges, {o for _, _, owners in found for o in owners}


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as (start, end) characters of the original text."""
    if not ranges:
        return []
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    wanted = [(at[a][0], at[b - 1][1]) for a, b in ranges]
    # bytes to characters: count the bytes that begin a character
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [(int(begins[s]) - 1, int(begins[e - 1])) for s, e in wanted]


HITS = pa.struct([
    ("n_words", pa.int64()),
    ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])
HITS_SQL = (
    "struct<n_words:long,ranges:array<struct<first:long,after:long>>,"
    "spans:array<struct<begin:long,end:long>>,items:array<string>>"
)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for first, after in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], after))
        else:
            out.append((first, after))
    return out


def hits_of(texts: list[str | None], parts: list[list[tuple]], window: int, cache: dict) -> list[dict]:
    """What all ``parts`` of the items find in each text; one automaton exists at a time."""
    found: list[tuple[int, list, set]] = [(0, [], set()) for _ in texts]
    for number, items in enumerate(parts):
        if number not in cache:
            cache.clear()
            cache[number] = build(items, window)
        for i, text in enumerate(texts):
            n, ranges, owners = search(cache[number], text)
            found[i] = (n, merged(found[i][1] + ranges) if found[i][1] else ranges, found[i][2] | owners)
    return [
        {"n_words": n, "ranges": [{"first": a, "after": b} for a, b in ranges], "items": sorted(owners),
         "spans": [{"begin": a, "end": b} for a, b in original_spans(text or "", ranges)]}
        for text, (n, ranges, owners) in zip(texts, found)
    ]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add a struct column ``name``: ``n_words``, word ``ranges``, character ``spans`` in the original, and ``items``.

    A null or empty text has no words and no hits. An item without words is no
    window; one whose id is null marks words but is not named. Repeated items
    and windows count once. ``name`` must be free; all other columns stay as
    they are. Empty tables give no hits, or no rows.

    A task holds the items of one broadcast, one automaton of ``part_bytes``
    and a bounded stretch of texts. Items beyond ``broadcast_bytes`` are
    searched by further passes over the rows, each adding to what is found.
    """
    spark = docs.sparkSession
    items = written(
        benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).distinct(), "items"
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes, parts = max(1, -(-size // broadcast_bytes)), max(1, -(-min(size, broadcast_bytes) // part_bytes))
    docs = docs.withColumn(name, F.lit(None).cast(HITS_SQL))
    for number in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).collect()
        own = [(r["item"], r["text"]) for r in own]
        docs = _one_pass(docs, spark.sparkContext.broadcast([own[i::parts] for i in range(parts)]), text, window, name)
        if number + 1 < passes:
            docs = written(docs, "hits")
    return docs


def _one_pass(docs: DataFrame, parts, text: str, window: int, name: str) -> DataFrame:
    places = docs.columns.index(text), docs.columns.index(name)

    def of(held: list[pa.RecordBatch], cache: dict) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in held for t in batch.column(places[0]).to_pylist()]
        made = hits_of(texts, parts.value, window, cache)
        for batch in held:
            new, made = made[: batch.num_rows], made[batch.num_rows :]
            for old, add in zip(batch.column(places[1]).to_pylist(), new):
                if old and old["ranges"]:
                    ranges = merged([(x["first"], x["after"]) for y in (old, add) for x in y["ranges"]])
                    add["ranges"] = [{"first": a, "after": b} for a, b in ranges]
                    add["items"] = sorted({*old["items"], *add["items"]})
                    add["spans"] = old["spans"] + add["spans"]
            columns = list(batch.columns)
            columns[places[1]] = pa.array(new, HITS)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(places[0]).nbytes
            if len(parts.value) == 1 or size >= SEARCHED_BYTES:
                yield from of(held, cache)
                held, size = [], 0
        if held:
            yield from of(held, cache)

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated; null ids keep their rows."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = find_hits(narrow, benchmark, "hits").drop("text")
    n_hit = F.aggregate("hits.ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["after"] - r["first"])
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs; all columns as they were."""
    name = free_name(docs, "hits")
    hits = find_hits(docs, benchmark, name, text)
    return hits.filter(F.size(F.col(name)["ranges"]) == 0).select(*docs.columns)
