"""Positions must hold for groups that spread over many partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import ordering


@pytest.fixture(autouse=True)
def several_slices(monkeypatch):
    """Narrow slices, as large data would have many of."""
    monkeypatch.setattr(ordering, "ROWS_PER_SLICE", 1000)


@pytest.fixture(scope="module")
def skewed(spark):
    # two thirds of the rows belong to one key, half of those share one instant
    ids = spark.range(60000).withColumn("key", F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))))
    late = F.timestamp_seconds((F.col("id") * 7919) % 10007)
    return ids.withColumn("ts", F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(5000))).otherwise(late))


def test_positions_match_row_number(skewed):
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = skewed.withColumn("want", F.row_number().over(w) - 1)
    got = ordering.with_position(skewed, ["key"], ["ts", "id"])
    assert got.count() == 60000
    assert got.join(want, ["key", "ts", "id"]).filter("position <> want").count() == 0


def test_hot_key_and_hot_instant_are_cut(skewed):
    sizes = ordering._sliced(skewed, ["key"], ["ts", "id"]).groupBy("_cell", "_part").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 3 * 1000 and sizes[1] >= 45


@pytest.mark.parametrize("rows", [20_000, 80_000])
def test_tables_of_slices_grow_with_the_rows_only(spark, rows):
    """One key, and many small ones: one entry per slice is carried on, and counts are one per slice and key."""
    slices = rows // ordering.ROWS_PER_SLICE
    one = ordering._sliced(spark.range(rows).withColumn("key", F.lit(1)), ["key"], ["id"])
    assert ordering._starts(one, ["id"]).count() <= 1.5 * slices
    assert one.groupBy("_key", "_cell", "_part").count().count() <= 1.5 * slices
    many = ordering._sliced(spark.range(rows).withColumn("key", F.col("id") % (rows // 20)), ["key"], ["id"])
    assert ordering._starts(many, ["id"]).count() <= 1.5 * slices
    assert many.groupBy("_key", "_cell", "_part").count().count() <= rows // 20 + 1.5 * slices


@pytest.mark.parametrize(("kind", "value"), [
    ("string", "concat('n', lpad(id, 9, '0'))"), ("decimal(20,3)", "cast(id as decimal(20,3)) / 7"), ("binary", "cast(lpad(id, 9, '0') as binary)"),
    ("date", "date_add(DATE '2024-01-01', cast(id as int))"), ("array", "array(id, 1)"), ("double", "-cast(id as double)"),
])
def test_any_kind_of_order_column_cuts_a_hot_key(spark, kind, value):
    rows = spark.range(20_000).select("id", F.expr(value).alias("at"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).alias("key"))
    sliced = ordering._sliced(rows, ["key"], ["at"])
    assert sliced.groupBy("_key", "_cell", "_part").count().agg(F.max("count")).first()[0] <= 3 * 1000
    got = ordering.with_position(rows, ["key"], ["at"])
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1).select("id", "want")
    assert got.join(want, "id").filter("position = want").count() == 20_000


def test_what_a_row_is_compared_with_does_not_grow(spark, monkeypatch):
    """Some 125 cuts in a cell: no array that rows are joined with holds them all, and slices stay as short."""
    longest, plain = [], ordering.written

    def spied(df, tag):
        table = plain(df, tag)
        arrays = [f.name for f in table.schema if f.dataType.typeName() == "array"]
        longest.extend(table.agg(F.max(F.size(c))).first()[0] or 0 for c in arrays)
        return table

    monkeypatch.setattr(ordering, "written", spied)
    sliced = ordering._sliced(spark.range(400_000).withColumn("key", F.col("id") % 3), ["key"], ["id"], 50)
    sizes = sliced.groupBy("_cell", "_part").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert max(longest) <= 64
    assert sizes[0] <= 5 * 50 and sizes[1] >= 6000


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_many_levels_of_cuts(skewed, monkeypatch, fan):
    monkeypatch.setattr(ordering, "FAN", fan)
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = skewed.select("id", (F.row_number().over(w) - 1).alias("want"), F.lag("id").over(w).alias("lagged"))
    got = ordering.with_position(skewed, ["key"], ["ts", "id"], each=40)
    assert got.join(want, "id").filter("position = want").count() == 60000
    before = ordering.with_previous(skewed, ["key"], ["ts", "id"], "id", "before", each=40)
    assert before.join(want, "id").filter("before <=> lagged").count() == 60000
    placed = ordering._sliced(skewed, ["key"], ["ts", "id"], 40).groupBy("_cell", "_part").agg(
        F.min(F.struct("key", "ts", "id")).alias("low"), F.max(F.struct("key", "ts", "id")).alias("high"))
    rising = placed.withColumn("next", F.lead("low").over(Window.orderBy("_cell", "_part")))
    assert rising.count() >= 1000 and rising.filter("next <= high").count() == 0


def test_columns_with_names_used_inside(spark):
    rows = spark.range(5000).select("id", *[(F.col("id") % 3).alias(c) for c in ("key", "at", "k0", "o0", "f0")])
    got = ordering.with_position(rows, ["key"], ["id"])
    assert got.columns == [*rows.columns, "position"] and got.filter("position <> floor(id / 3)").count() == 0


def test_one_key_with_nine_tenths_of_the_rows(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("key"))
    got = ordering.with_position(rows, ["key"], ["id"]).filter("key = 1").agg(F.max("position"), F.countDistinct("position"))
    assert tuple(got.first()) == (45_000 - 1 + 0, 45_000)


@pytest.mark.parametrize("slice_rows", [2, 10**6])
def test_null_keys_and_null_order_values_keep_their_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ordering, "ROWS_PER_SLICE", slice_rows)
    rows = [(None, 3), (None, 1), (None, None), ("a", 2), ("a", 1), (None, 7), ("a", None)]
    df = spark.createDataFrame(rows, "key string, at int")
    got = {(r.key, r.at): r.position for r in ordering.with_position(df, ["key"], ["at"]).collect()}
    assert got == {(None, None): 0, (None, 1): 1, (None, 3): 2, (None, 7): 3, ("a", None): 0, ("a", 1): 1, ("a", 2): 2}
    before = {(r.key, r.at): r.before for r in ordering.with_previous(df, ["key"], ["at"], "at", "before").collect()}
    assert before == {(None, None): None, (None, 1): None, (None, 3): 1, (None, 7): 3, ("a", None): None, ("a", 1): None, ("a", 2): 1}
    assert ordering.with_position(df.limit(0), ["key"], ["at"]).count() == 0


def test_global_positions(skewed):
    got = ordering.with_position(skewed, [], ["ts", "id"])
    stats = got.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(stats) == (0, 59999, 60000)


def test_previous_matches_lag(skewed):
    unique = skewed.withColumn("at", F.col("id") * 3)
    got = ordering.with_previous(unique, ["key"], ["at"], "at", "before")
    w = Window.partitionBy("key").orderBy("at")
    want = unique.withColumn("want", F.lag("at").over(w)).select("id", "want")
    assert got.join(want, "id").filter("NOT (before <=> want)").count() == 0


def test_sampling_distance():
    assert [ordering.one_in_n(r) for r in (1.0, 0.6, 0.5, 0.3, 0.05)] == [1, 1, 2, 3, 20]
    assert ordering.one_in_n(0) == 2**31 - 1
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            ordering.one_in_n(bad)


def test_rate_zero_keeps_the_first(skewed):
    kept = ordering.sample_one_in_n(skewed, ["key"], ["ts", "id"], 0.0)
    assert kept.count() == skewed.select("key").distinct().count()


def test_sequence_ids(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "task int, at int")
    got = {(r.task, r.at): r.sid for r in ordering.assign_sequence_id(rows, "s", "task", ["at"]).collect()}
    assert got == {(1, 3): "s1-0", (1, 5): "s1-1", (2, 9): "s2-0"}
