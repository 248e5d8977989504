"""SimHash near-duplicates, verified through pivot distance tables.

The Hamming distance to a reference fingerprint (a pivot) is a coordinate, and
by the triangle inequality two fingerprints that differ in at most ``bits``
bits differ by at most ``bits`` in every coordinate. A table with the distances
of each fingerprint to many pivots therefore discards almost all pairs before
their bits are compared.

Pairs come together losslessly: of ``BLOCKS`` bit blocks, at most ``bits`` can
differ, so ``BLOCKS - bits`` blocks are equal in every pair to be found, and
fingerprints meet once for each such choice of blocks. Where very many share a
choice (a large group of near copies), they are cut into chunks and each pair
of chunks is one unit of work, so no group lands in one task whole.

Blocks of bits cannot bring pairs together that differ in ten bits or more, as
texts at a similarity of 0.8 do. For a threshold on the Jaccard similarity of
the sets of shingles, texts meet by equal bands of minimum hashes and a wide
radius instead, and the pivot tables of such a loose group are those of the
whole sets: the Hamming distance of two sets, as vectors of bits over all
shingles, is the number of shingles that only one of them has. Two sets of at
least ``share`` similarity are at most ``1 / share - 1`` times the smaller one
apart, so pairs that differ by more in any coordinate are discarded without
loss, and the survivors are decided by their exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.components import components
from tidegauge.llm.frames import free_name, map_column, spread_count
from tidegauge.llm.words import word_lists
from tidegauge.session import spread, written

SHINGLE = 4
SEED = 42
BITS = 4
BLOCKS = 6
PIVOTS = 32
CHUNK = 2048
ROWS_PER_TASK = 200_000
PAIRS_AT_ONCE = 2_000_000
#: Bands of minimum hashes: a pair at similarity 0.8 shares none with probability (1 - 0.8^5)^24 = 0.00007.
BANDS = 24
IN_BAND = 5
#: Differing bits from which texts that share a band are not compared; at similarity 0.8 they differ in about ten.
WIDE = 24
#: Texts whose sets of shingles are compared with each other at once, and shingles they have together.
TEXTS = 512
SET_SIZES = 1 << 21
#: Places that the rows of one loose group are dealt to.
SALTS = 16
#: Sets of a unit for each set among them that is a pivot.
SETS_PER_PIVOT = 8
HASHES_AT_ONCE = 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``shingle`` words, piece by piece; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    some, tail = False, []
    for found in word_lists(text, size):
        words = tail + found
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]
        if hashes:
            some = True
            yield np.array(hashes, np.uint64)
        tail = words[max(0, len(words) - shingle + 1):]
    if tail and not some:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that more than half of the hashes have."""
    votes, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += hashes.size
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, size: int = 1 << 20) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, size))


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed long; all other columns stay as they are."""

    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    copy = free_name(docs, "text_in")
    rows = docs.withColumn(copy, F.col(text))
    return map_column(rows if keep_text else rows.drop(text), copy, f"`{name}` long", lambda a: [prints(a)])


def hex_text(column: str):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def block_masks(bits: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - bits`` blocks, as signed longs."""
    if not 0 <= bits < blocks <= 64:
        raise ValueError("a pair can only be found if more blocks than differing bits are cut")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(one[i] for i in choice) for choice in combinations(range(blocks), blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivot_table(prints: np.ndarray, pivots: int) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints, one row per pivot."""
    references = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(pivots)], np.uint64)
    return np.array([np.bitwise_count(prints ^ r) for r in references], np.int8).reshape(pivots, prints.size)


class Forest:
    """Union-find over array positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            self._flatten()


def _pairs(starts: np.ndarray, sizes: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside runs, or between the two sides of a run, in bounded arrays.

    ``sides`` is 0 in runs that are compared with themselves, and 1 or 2 in
    runs that hold two chunks, sorted by side.
    """
    for size in np.unique(sizes[sizes > 1]):
        of_size = starts[sizes == size]
        own = of_size[sides[of_size] == 0]
        if own.size:
            row, column = (x.astype(np.int64) for x in np.triu_indices(size, 1)) if size <= 512 else (None, None)
            if row is not None:
                step = max(1, PAIRS_AT_ONCE // row.size)
                for i in range(0, own.size, step):
                    base = own[i : i + step, None]
                    yield (base + row).ravel(), (base + column).ravel()
            else:
                for first in own:
                    yield from _blocks(np.arange(first, first + size), None)
        for first in of_size[sides[of_size] != 0]:
            run = np.arange(first, first + size)
            yield from _blocks(run[sides[run] == 1], run[sides[run] == 2])


def _blocks(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    other = left if right is None else right
    if not other.size:
        return
    step = max(1, PAIRS_AT_ONCE // other.size)
    for i in range(0, left.size, step):
        a, b = np.repeat(left[i : i + step], other.size), np.tile(other, left[i : i + step].size)
        yield (a, b) if right is not None else (a[a < b], b[a < b])


def _linked(batches: Iterator[pa.RecordBatch], bits: int, pivots: int) -> Iterator[pa.RecordBatch]:
    """Star-shaped links of one task's units of work."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    columns = {n: table.column(n).to_numpy() for n in ("which", "value", "low", "high", "side", "print")}
    order = np.lexsort([columns[n] for n in ("side", "high", "low", "value", "which")])
    columns = {n: c[order] for n, c in columns.items()}
    change = np.ones(order.size, bool)
    change[1:] = np.any([columns[n][1:] != columns[n][:-1] for n in ("which", "value", "low", "high")], axis=0)
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, order.size))
    prints, place = np.unique(columns["print"].view(np.uint64), return_inverse=True)
    table_of = pivot_table(prints, pivots)
    forest = Forest(prints.size)
    for a, b in _pairs(starts, sizes, columns["side"]):
        a, b = place[a], place[b]
        for distances in table_of:
            near = np.abs(distances[a] - distances[b]) <= bits
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= bits
        forest.join(a[near], b[near])
    moved = np.flatnonzero(forest.root != np.arange(prints.size))
    signed = prints.view(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(signed[moved]), pa.array(signed[forest.root[moved]])], names=["a", "b"]
    )


def link_prints(
    prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, pivots: int = PIVOTS, chunk: int = CHUNK
) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct ``print`` values connected at ``bits`` or fewer differing bits.

    What leaves a task is one link per fingerprint that is not alone, never all
    pairs of a group. A link joins members of a component, not always a pair
    within ``bits``.
    """
    masks = F.array(*[
        F.struct(F.lit(i).alias("which"), F.col("print").bitwiseAND(F.lit(m)).alias("value"))
        for i, m in enumerate(block_masks(bits, blocks))
    ])
    keyed = prints.select("print", F.explode(masks).alias("key")).select("print", "key.*")
    return link_keyed(keyed, prints.count() * len(block_masks(bits, blocks)), bits, pivots, chunk)


def link_keyed(
    keyed: DataFrame, rows: int, bits: int, pivots: int = PIVOTS, chunk: int = CHUNK
) -> DataFrame:
    """Links ``(a, b)`` that connect the ``print`` values that share a ``(which, value)`` and differ in at most ``bits`` bits."""
    spark = keyed.sparkSession
    crowded = written(
        keyed.groupBy("which", "value").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > chunk)
        .withColumn("chunks", F.ceil(F.col("rows") / chunk).cast("int")),
        "crowded",
    )
    own = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    each = (
        keyed.join(crowded.drop("rows"), ["which", "value"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    )
    units = each.select(
        "print", "which", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    tasks = spread_count(rows, ROWS_PER_TASK)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return units.repartition(tasks, "which", "value", "low", "high").mapInArrow(
        lambda batches: _linked(batches, bits, pivots), "a long, b long"
    )


def print_components(rows: DataFrame, print_name: str, doc_id: str, **options) -> DataFrame:
    """``(print, root, component_id)`` for every distinct fingerprint of ``rows``; ids may be null or repeated."""
    prints = written(rows.groupBy(F.col(print_name).alias("print")).agg(F.min(doc_id).alias("first")), "prints")
    roots = written(components(link_prints(prints, **options)), "roots")
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    A null or empty text, and one of white space only, has fingerprint zero and
    is linked like any other. Repeated rows each give a row. A null id keeps
    its row; ``component_id`` is the smallest id that is not null, or null if a
    component has none. Other columns play no part, whatever their names. An
    empty table gives an empty result. A text is worked through in pieces of
    1 MB, so very long ones need no more memory than their words in a piece.
    """
    rows = written(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "print", keep_text=False),
        "fingerprints",
    )
    found = print_components(rows, "print", "doc_id", **options)
    return rows.join(found, "print").select("doc_id", hex_text("print").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a single zero for a text without words."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def _minima_keys() -> tuple[np.ndarray, np.ndarray]:
    """What a hash is turned and multiplied by for each minimum."""
    made = np.array([xxhash.xxh64_intdigest(b"minimum %d" % i, SEED) for i in range(2 * BANDS * IN_BAND)], np.uint64)
    return made[::2, None], made[1::2, None] | np.uint64(1)


MINIMA = _minima_keys()


def sketch(text: str | None, shingle: int) -> tuple[int, int, int, np.ndarray]:
    """``(digest, print, size, bands)`` of the set of shingles: equal sets have equal digests; all signed."""
    own = shingle_set(text, shingle)
    turned, times = MINIMA
    parts = [own[i : i + HASHES_AT_ONCE] for i in range(0, own.size, HASHES_AT_ONCE)]
    least = np.min([(((p ^ turned) * times).min(axis=1)) for p in parts], axis=0)
    bands = [xxhash.xxh64_intdigest(least[i : i + IN_BAND].tobytes(), i) for i in range(0, least.size, IN_BAND)]
    signed = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), majority(iter(parts)), *bands], np.uint64).view(np.int64)
    return int(signed[0]), int(signed[1]), own.size, signed[2:]


def with_sketch(docs: DataFrame, digest: str, name: str, size: str, bands: str, text: str, shingle: int) -> DataFrame:
    """Add what :func:`sketch` gives; all other columns stay as they are."""

    def sketches(texts: pa.Array) -> list[pa.Array]:
        made = [sketch(t, shingle) for t in texts.to_pylist()]
        flat = np.concatenate([m[3] for m in made]) if made else np.zeros(0, np.int64)
        return [
            *(pa.array([m[i] for m in made], pa.int64()) for i in range(3)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * BANDS), pa.array(flat)),
        ]

    copy = free_name(docs, "text_in")
    makes = f"`{digest}` long, `{name}` long, `{size}` long, `{bands}` array<long>"
    return map_column(docs.withColumn(copy, F.col(text)), copy, makes, sketches)


class SetTable:
    """Sets of one unit of work, with their sizes and the numbers of values in common."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([x.size for x in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        values, self.place = np.unique(np.concatenate(sets), return_inverse=True)
        self.has = np.zeros(values.size, bool)

    def own(self, i: int) -> np.ndarray:
        return self.place[self.starts[i] : self.starts[i] + self.sizes[i]]

    def common(self, i: int, other: np.ndarray | None = None) -> np.ndarray:
        """How many values set ``i`` shares with each of ``other`` (all sets by default)."""
        sizes = self.sizes if other is None else self.sizes[other]
        place = self.place if other is None else np.concatenate([self.own(j) for j in other])
        self.has[self.own(i)] = True
        found = np.add.reduceat(self.has[place], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.has[self.own(i)] = False
        return found

    def distances(self, pivots: int) -> list[np.ndarray]:
        """Hamming distances of all sets to the empty set and to ``pivots`` of the sets, each far from those before it."""
        table, gap, at = [self.sizes], np.full(self.sizes.size, np.inf), int(np.argmax(self.sizes))
        for _ in range(pivots):
            both = self.sizes + self.sizes[at]
            table.append(both - 2 * self.common(at))
            gap = np.minimum(gap, table[-1] / both)
            at = int(np.argmax(gap))
        return table


def exact_links(sets: list[np.ndarray], sides: np.ndarray, share: float, pivots: int = PIVOTS) -> tuple[np.ndarray, int]:
    """For each set the first of those that it is connected to by pairs of at least ``share`` exact Jaccard similarity.

    Sets of side 0 are compared with each other, those of side 1 with those of
    side 2. The second value is the number of pairs whose similarity was
    counted: those that no pivot discards and that are not connected yet.
    """
    forest = Forest(len(sets))
    table = SetTable(sets)
    coordinates = table.distances(min(pivots, len(sets) // SETS_PER_PIVOT))
    counted = 0
    for i in np.flatnonzero(sides != 2):
        other = np.flatnonzero((sides == (2 if sides[i] else 0)) & (forest.root != forest.root[i]))
        if not sides[i]:
            other = other[other > i]
        reach = (1 / share - 1) * np.minimum(table.sizes[other], table.sizes[i]) + 1e-6
        for distances in coordinates:
            near = np.abs(distances[other] - distances[i]) <= reach
            other, reach = other[near], reach[near]
        if not other.size:
            continue
        counted += other.size
        common = table.common(i, other)
        other = other[common >= share * (table.sizes[other] + table.sizes[i] - common) - 1e-9]
        forest.join(np.full(other.size, i), other)
    return forest.root, counted


def crowded_groups(grouped: DataFrame, chunk: int, sizes: int) -> DataFrame:
    """``(digest, loose, chunks)`` of ``grouped(digest, size, loose)`` without groups of one row.

    The rows of a group are dealt to ``SALTS`` places, so a large one does not
    meet in one task; the table of groups is repeated as often.
    """
    crowds = grouped.groupBy("loose").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes")).filter("n > 1").select(
        "loose", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("sizes") / sizes)).cast("int").alias("chunks"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("digest", F.lit("salt")), F.lit(SALTS)).cast("int")
    return grouped.withColumn("salt", salt).join(crowds, ["loose", "salt"]).select("digest", "loose", "chunks")


def similar_components(
    rows: DataFrame, names: tuple[str, str, str, str], doc_id: str, text: str, share: float, shingle: int,
    chunk: int = TEXTS, sizes: int = SET_SIZES,
) -> DataFrame:
    """``(print, root, component_id)`` as of :func:`print_components`, with the digest of the set of shingles as ``print``.

    Components join pairs of at least ``share`` exact Jaccard similarity. One
    text stands for all with the same set. A loose group of more than
    ``chunk`` sets, or of more than ``sizes`` shingles, is compared by pairs of
    chunks, each a group of its own. The texts themselves travel: a set of
    hashes is larger than the words it was made from.
    """
    digest, name, size, bands = names
    sets = written(
        rows.groupBy(F.col(digest).alias("digest"), F.col(name).alias("print"))
        .agg(F.min(doc_id).alias("first"), F.first(size).alias("size"), F.first(bands).alias("bands")),
        "sets",
    )
    keyed = sets.select("print", F.lit(0).alias("which"), F.explode("bands").alias("value"))
    # so far apart, pivots of single fingerprints discard nothing; those of the sets follow inside the groups
    loose = written(components(link_keyed(keyed, sets.count() * BANDS, WIDE, pivots=0)), "loose")
    grouped = written(
        sets.select("digest", "print", "size").join(loose.withColumnRenamed("node", "print"), "print", "left")
        .select("digest", "size", F.coalesce("root", "print").alias("loose")),
        "grouped",
    )
    suspects = written(crowded_groups(grouped, chunk, sizes), "suspects")
    # copies combine in each task before they are shuffled
    texts = rows.groupBy(F.col(digest).alias("digest")).agg(F.first(text).alias("text")).join(suspects, "digest")
    own = F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")
    each = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = each.select(
        "digest", "text", "loose", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def linked(unit: pa.Table) -> pa.Table:
        found = [shingle_set(t, shingle) for t in unit.column("text").to_pylist()]
        roots, _ = exact_links(found, unit.column("side").to_numpy(), share)
        moved = np.flatnonzero(roots != np.arange(roots.size))
        known = unit.column("digest").to_numpy()
        return pa.table({"a": pa.array(known[moved]), "b": pa.array(known[roots[moved]])})

    links = spread(units, "loose", "low", "high").groupBy("loose", "low", "high").applyInArrow(linked, "a long, b long")
    roots = written(components(links), "roots")
    rooted = sets.select(F.col("digest").alias("print"), "first").join(
        roots.withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("root", F.coalesce("root", "print"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("print", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every component: that with the smallest id, null ids last; all columns as they were.

    If several rows carry that id, any one of them stays.
    """
    name = free_name(docs, "print")
    rows = written(with_fingerprint(docs, name, text), "fingerprinted")
    return _smallest(docs, rows, name, print_components(rows, name, doc_id, **options), doc_id)


def keep_one_similar(
    docs: DataFrame, share: float, shingle: int, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row of every group of texts whose sets of ``shingle``-word runs have at least ``share`` Jaccard similarity.

    Chains connect. What stays is as in :func:`keep_one`. No pair below
    ``share`` is linked; one at or above it can be missed if it shares no band
    of minimum hashes or differs in more than ``WIDE`` bits.
    """
    names = tuple(free_name(docs, n) for n in ("digest", "set_print", "set_size", "bands"))
    rows = written(with_sketch(docs, *names, text, shingle), "sketched")
    found = similar_components(rows, names, doc_id, text, share, shingle, **options)
    return _smallest(docs, rows.drop(*names[1:]), names[0], found, doc_id)


def _smallest(docs: DataFrame, rows: DataFrame, name: str, found: DataFrame, doc_id: str) -> DataFrame:
    """Of every component the row of ``rows`` with the smallest id, with the columns of ``docs``."""
    root, best = free_name(rows, "root_print"), free_name(rows, "best_id")
    chosen = rows.join(
        found.select(F.col("print").alias(name), F.col("root").alias(root), F.col("component_id").alias(best)), name
    ).filter(F.col(doc_id).eqNullSafe(F.col(best)))
    # rows that share an id are rare: only they are dealt out by component
    ids = rows.select(F.col(name).alias("print"), F.col(doc_id).alias("id")).join(found, "print")
    repeated = written(
        ids.filter(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("root").alias(root)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(root),
        "repeated",
    )
    if repeated.isEmpty():
        return chosen.select(*docs.columns)
    once = chosen.join(repeated, root, "left_anti").select(*docs.columns)
    some = chosen.join(repeated, root, "left_semi").dropDuplicates([root]).select(*docs.columns)
    return once.unionByName(some)
