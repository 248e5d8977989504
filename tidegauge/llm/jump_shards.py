"""Sharding by jump consistent hashing, in built-in expressions only.

The published loop (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash
Algorithm", 2014): the key seeds a 64-bit linear congruential generator, and
each draw says at which number of shards the key moves next; the last move
below the number of shards is the key's shard. No ring table is kept, and one
more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.frames import free_name, spread_count
from tidegauge.session import written

# Fixed values of the published generator: 2862933555777941757 in 32-bit halves.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
WORD = 0xFFFFFFFF
ROWS_PER_RANGE = 50_000


def _times(word: Column, factor: int) -> tuple[Column, Column]:
    """``(high, low)`` 32-bit words of a 32-bit word times a 32-bit factor; nothing here exceeds 49 bits."""
    upper = F.shiftright(word, 16) * F.lit(factor)
    lower = word.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(upper, 16) + F.shiftright(lower, 32), lower.bitwiseAND(F.lit(WORD))


def _draw(state: Column) -> Column:
    """The next state: key * factor + 1 modulo 2^64, as two words, with the jump it gives."""
    carry, low = _times(state["low"], LOW)
    low = low + 1
    carry = carry + F.shiftright(low, 32)
    high = carry + _times(state["high"], LOW)[1] + _times(state["low"], HIGH)[1]
    return F.struct(high.bitwiseAND(F.lit(WORD)).alias("high"), low.bitwiseAND(F.lit(WORD)).alias("low"))


def stable_key(column: Column, kind: str) -> Column:
    """The 64-bit key of a column: whole numbers as they are, anything else by its hash, null as zero."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(column.cast("bigint") if whole else F.xxhash64(column.cast("string")), F.lit(0).cast("bigint"))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = key.cast("bigint")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(WORD)).alias("low"),
        F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        drawn = _draw(state)
        # (next + 1) * 2^31 / (key / 2^33 + 1), as in the published code in double precision
        top = F.shiftright(drawn["high"], 1) + 1
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(2.0**31) / top.cast("double"))).cast("bigint")
        moved = F.struct(
            drawn["high"].alias("high"), drawn["low"].alias("low"),
            state["next"].alias("shard"), jump.alias("next"),
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    # each draw moves on by one shard at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["shard"].cast("int")


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add each row's shard; a null key counts as zero. Other columns stay, one of the same name is replaced."""
    return df.withColumn(name, jump_shard(stable_key(F.col(key), dict(df.dtypes)[key]), shards))


def with_slots(counted: DataFrame, shard: str, order: list[str], rows: str, name: str = "slot") -> DataFrame:
    """Unfold ``rows`` equal rows each into rows with gapless places, from 0, inside their shard.

    Places come from sums over ranges of hashed rows: only a range's rows meet
    in one task, and a shard of any size covers many ranges.
    """
    part, place, before = (free_name(counted, n) for n in ("range", "place", "before"))
    total = counted.agg(F.coalesce(F.count(F.lit(1)), F.lit(0))).first()[0]
    ranges = spread_count(total, ROWS_PER_RANGE)
    parted = counted.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(ranges)))
    sums = parted.groupBy(shard, part).agg(F.sum(rows).alias(place))
    ahead = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(shard, part, F.coalesce(F.sum(place).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(before) + F.coalesce(F.sum(rows).over(inside), F.lit(0))
    return (
        parted.join(starts, [shard, part]).withColumn(place, first)
        .withColumn(name, F.explode(F.sequence(F.col(place), F.col(place) + F.col(rows) - 1)))
        .drop(part, place, before, rows)
    )


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its size, checksum, shard, place in the shard, and shard after one more is added.

    The law is ``key``: id and number of shards decide. A null text counts as
    empty, a null id as the key zero. Rows that are equal in id, size and
    checksum are counted together first, so copies of one row, however many,
    cross the network as one row per task; each still gets its own place.
    Other columns play no part. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    counted = written(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows")), "counted")
    sharded = with_shard(with_shard(counted, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    placed = with_slots(sharded, "shard", ["doc_id", "size", "text_crc32"], "rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write all columns as one folder per shard; a large shard is written by many tasks."""
    name = free_name(df, "shard")
    with_shard(df, key, shards, name).write.partitionBy(name).parquet(path)
