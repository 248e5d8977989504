"""Positions inside ordered groups, without one task per group.

A plain ``row_number`` window puts a whole group into one task. Here all rows
are seen in one order, by key and then by the order columns, and cut into
slices of it that hold about the same number of rows. So a slice holds many
small groups, or a part of a large one, and only the first group of a slice can
have rows before it. One combining pass counts the rows of each group in each
slice; the window then numbers the rows of a group inside a slice, from where
the slices before left off. Keys are compared as structs, so NULL keys are
groups like any other, and any kind of column that can be sorted can be cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import written

#: Rows that one slice should hold.
ROWS_PER_SLICE = 500_000
#: Sampled rows per slice, from which cuts are chosen.
SAMPLED = 20
#: Cells of the first level at most, whose cuts are part of the plan; each has cuts of its own in a table.
CELLS = 64
#: A row looks at fewer cuts than this in one array; more levels of arrays are there for cells with more cuts.
FAN = 64
SEED = 17
#: A group's rows in a slice; the number that tells most slices apart is compared first.
SLICE = ["_part", "_cell", "_key"]
_PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _place(keys: Sequence[str], order: Sequence[str]) -> tuple[Column, Column]:
    """Key of a row, and its place in the order of all rows; fields have names of their own."""
    key = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    return key, F.struct(key.alias("key"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("at"))


def _plain_fields(place: T.StructType) -> list[tuple[str, T.DataType]]:
    """The leading fields of a place that a cut of the first level can have in the plan."""
    fields = [(f"{part.name}.{f.name}", f.dataType) for part in place for f in part.dataType if f.name != "_"]
    plain = []
    for name, kind in fields:
        if not isinstance(kind, _PLAIN):
            break
        plain.append((name, kind))
    return plain


def _counted(df: DataFrame, cuts: Column, value: Column, most: int, name: str) -> DataFrame:
    """Add how many of the rising ``cuts``, ``most`` at most, are at or below ``value``; without cuts that is none.

    Every halving is a projection of its own, so that Spark compiles it: cuts are looked at in place, never copied to a row.
    Cuts should have the very type of ``value``, or each comparison casts both.
    """
    df = df.withColumn(name, F.lit(0))
    for b in reversed(range(most.bit_length())):
        found = F.get(cuts, F.col(name) + ((1 << b) - 1)) <= value
        df = df.withColumn(name, F.col(name) + F.when(found, 1 << b).otherwise(0))
    return df


def _heads(sample: DataFrame, total: int) -> list[Column]:
    """First places of the cells but one, on the leading plain fields: a bounded part of the sample is divided evenly by them."""
    plain = _plain_fields(sample.schema["_place"].dataType)
    cells = min(CELLS, total // (8 * SAMPLED))
    if not plain or cells < 2:
        return []
    fields = [F.col(f"_place.{name}").alias(f"f{i}") for i, (name, _) in enumerate(plain)]
    some = sample.sample(min(1.0, 32.0 * CELLS / total), SEED).select(*fields).orderBy(*[f"f{i}" for i in range(len(plain))]).collect()
    step = max(1, len(some) // cells)
    return [F.struct(*[F.lit(v).cast(kind).alias(f"f{i}") for i, (v, (_, kind)) in enumerate(zip(r, plain))]) for r in some[step::step]]


def _in_cells(df: DataFrame, heads: Sequence[Column]) -> DataFrame:
    """Add ``_cell``, the cell of a place."""
    if not heads:
        return df.withColumn("_cell", F.lit(0))
    plain = _plain_fields(df.schema["_place"].dataType)
    kind = T.StructType([T.StructField(f"f{i}", kind) for i, (_, kind) in enumerate(plain)])
    df = df.withColumn("_head", F.struct(*[F.col(f"_place.{name}").alias(f"f{i}") for i, (name, _) in enumerate(plain)]).cast(kind))
    return _counted(df, F.array(*heads).cast(T.ArrayType(kind)), F.col("_head"), len(heads), "_cell").drop("_head")


def _runs(sample: DataFrame) -> list[DataFrame]:
    """The cuts of the cells as tables of short arrays, coarsest first.

    In a cell every so many sampled places, but near the end, one is a cut. Cuts
    are numbered from 1, and with numbers in base :data:`FAN` a table holds those
    that end in as many zeros, by the digits before their last other one: whoever
    knows the leading digits of a slice finds the next in one array.
    """
    inside = Window.partitionBy("_cell").orderBy("_place")
    numbered = sample.withColumn("_n", F.row_number().over(inside)).withColumn("_more", F.lead(F.lit(True), SAMPLED // 2).over(inside))
    chosen = numbered.filter((F.col("_n") % SAMPLED == 0) & F.col("_more").isNotNull())
    cuts = written(chosen.select("_cell", (F.col("_n") / SAMPLED).cast("int").alias("_n"), "_place"), "cuts")
    most = cuts.agg(F.max("_n")).first()[0] or 0
    tables, unit = [], 1
    while unit <= most:
        own = cuts.filter((F.col("_n") % unit == 0) & (F.col("_n") % (unit * FAN) != 0))
        run = F.floor(F.col("_n") / (unit * FAN)).cast("int").alias("_part")
        tables.insert(0, written(own.groupBy("_cell", run).agg(F.sort_array(F.collect_list("_place")).alias("_cuts")), "runs"))
        unit *= FAN
    return tables


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], each: int | None = None) -> DataFrame:
    """Rows with ``_key``, and ``_cell`` and ``_part`` as their slice: both rise along the place of a row."""
    key, place = _place(keys, order)
    each = each or ROWS_PER_SLICE
    sample = written(df.select(place.alias("_place")).sample(min(1.0, SAMPLED / each), SEED), "places")
    heads = _heads(sample, max(1, sample.count()))
    place = place.cast(sample.schema["_place"].dataType)
    placed = _in_cells(df.select("*", key.alias("_key"), place.alias("_place")), heads).withColumn("_part", F.lit(0))
    for runs in _runs(_in_cells(sample, heads)):
        found = _counted(placed.join(runs, ["_cell", "_part"], "left"), F.col("_cuts"), F.col("_place"), FAN - 1, "_digit")
        placed = found.withColumn("_part", F.col("_part") * FAN + F.col("_digit")).drop("_cuts", "_digit")
    return placed.select(*df.columns, "_key", "_cell", "_part")


def _starts(sliced: DataFrame, order: Sequence[str], carry: bool = True) -> DataFrame:
    """Where a group goes on in a slice: how many of its rows are before it and, to ``carry``, the last order values before it.

    That is at most one group per slice, however many there are. Only the
    counts of slices meet per group, never its rows.
    """
    last = [F.max(F.struct(*order)).alias("_last")] if carry else []
    counts = sliced.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("_rows"), *last)
    before = Window.partitionBy("_key").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_start", F.sum("_rows").over(before))
    if carry:
        rows = rows.withColumn("_carried", F.max("_last").over(before)).drop("_last")
    return written(rows.filter("_start IS NOT NULL").drop("_rows"), "starts")


def _inside(order: Sequence[str]) -> Window:
    return Window.partitionBy(*SLICE).orderBy(*order)


def _continued(df: DataFrame, keys: Sequence[str], order: Sequence[str], each: int | None, carry: bool) -> DataFrame:
    if df.count() <= (each or ROWS_PER_SLICE):
        # one slice holds all rows: no cut is needed, and no group goes on in another
        last = df.select(F.struct(*order).alias("_last")).schema["_last"].dataType
        whole = [F.lit(0).alias("_cell"), F.lit(0).alias("_part"), F.lit(None).cast("bigint").alias("_start"), F.lit(None).cast(last).alias("_carried")]
        return df.select("*", _place(keys, order)[0].alias("_key"), *whole)
    sliced = _sliced(df, keys, order, each)
    return sliced.join(_starts(sliced, order, carry), SLICE, "left")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", each: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row inside its group; NULL order values come first.

    ``each`` is how many rows a slice should hold, :data:`ROWS_PER_SLICE` by default.

    Rows that agree in the key and in every order column stay in one slice: give
    an order column that tells them apart if there can be very many.
    """
    number = F.row_number().over(_inside(order)).cast("long") - 1
    return _continued(df, keys, order, each, carry=False).select(*df.columns, (F.coalesce("_start", F.lit(0)) + number).alias(name))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, each: int | None = None
) -> DataFrame:
    """Add ``value`` of the row before, inside the group; NULL for the first row.

    ``value`` must be one of the ``order`` columns.
    """
    inside = _inside(order)
    head = F.row_number().over(inside) == 1
    before = F.when(head, F.col(f"_carried.{value}")).otherwise(F.lag(value).over(inside))
    return _continued(df, keys, order, each, carry=True).select(*df.columns, before.alias(name))


def one_in_n(rate: float) -> int:
    """Sampling distance for a rate; a rate of zero keeps only the first row."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"sample rate must lie in [0, 1]: {rate}")
    largest = 2**31 - 1
    return largest if rate == 0 else min(int(1.0 / rate), largest)


def sample_one_in_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], rate: float) -> DataFrame:
    """Keep positions 0, N, 2N, ... of every group."""
    n = one_in_n(rate)
    if n == 1:
        return df
    return with_position(df, keys, order, "_position").filter(F.col("_position") % n == 0).drop("_position")


def assign_sequence_id(
    df: DataFrame, prefix: str | Column, task: str, order: Sequence[str], name: str = "sid"
) -> DataFrame:
    """Add ``prefix + task + '-' + counter``, counting from zero per task."""
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (
        with_position(df, [task], order, "_position")
        .withColumn(name, F.concat(lead, F.col(task).cast("string"), F.lit("-"), F.col("_position").cast("string")))
        .drop("_position")
    )
