"""Counters across micro-batches as a log of small tables, merged now and then."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a table of counters is split into, by a hash of the key. It must not change while a stream lives.
BUCKETS = 64
#: So many tables of one level are merged into one of the next.
FAN = 8


class Run(NamedTuple):
    """One written table: the counters that batches ``first`` to ``last`` touched, merged ``level`` times."""

    level: int
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"run={self.level}-{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class CounterLog:
    """The highest count of every key, of which a batch writes only those it touched.

    Each batch adds one table with its own keys. :data:`FAN` tables of a level
    become one of the next level, so a counter is written again once per level,
    that is a logarithm of the number of batches, and there are at most
    :data:`FAN` tables of each level. Tables are split into buckets of keys, and
    a batch reads only the buckets its keys fall in. Counts only grow, so the
    highest one of a key holds, whichever tables it is in.

    A table counts once its success marker is there. Merging before a batch uses
    tables of earlier batches only, and those go after the merged one is whole:
    wherever a batch is broken off, its repetition finds the same counters.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: T.StructType):
        self.spark, self.folder, self.names = spark, folder, list(keys.names)
        fields = [T.StructField(f.name, f.dataType) for f in keys]
        self.schema = T.StructType([*fields, T.StructField("_seen", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        self.path = self._hadoop(folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def key(self) -> Column:
        """The key columns as one value, in which NULL equals NULL."""
        return F.struct(F.lit(0).alias("_"), *self.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(BUCKETS)).cast("int")

    def runs(self, batch_id: int) -> list[Run]:
        """The whole tables of batches before ``batch_id``, without those that a merged one has replaced."""
        if not self.files.exists(self.path):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self.path)]
        found = [Run(*map(int, n.removeprefix("run=").split("-"))) for n in names if n.startswith("run=")]
        whole = [
            r for r in found
            if r.last < batch_id and self.files.exists(self._hadoop(f"{self.folder}/{r.folder}/_SUCCESS"))
        ]
        return sorted(r for r in whole if not any(o.covers(r) for o in whole))

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/{r.folder}" for r in runs]
        # each table is its own root, so that only the bucket is a partition column
        tables = [self.spark.read.schema(self.schema).parquet(p) for p in paths]
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.unionByName(table)
        return rows

    def _write(self, counters: DataFrame, run: Run) -> None:
        # one file per bucket; keys are hashed, so buckets are even
        counters.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{run.folder}")

    def compact(self, batch_id: int) -> None:
        """Merge the levels that are full, of tables of batches before ``batch_id``, and delete what is replaced."""
        level = 0
        while True:
            runs = self.runs(batch_id)
            same = [r for r in runs if r.level == level]
            if len(same) >= FAN:
                merged = self._read(same).groupBy(*self.names, "_bucket").agg(F.max("_seen").alias("_seen"))
                self._write(merged, Run(level + 1, same[0].first, same[-1].last))
            elif not any(r.level > level for r in runs):
                break
            level += 1
        self._drop_replaced(batch_id)

    def _drop_replaced(self, batch_id: int) -> None:
        if not self.files.exists(self.path):
            return
        kept = {r.folder for r in self.runs(batch_id)}
        for x in self.files.listStatus(self.path):
            name = x.getPath().getName()
            if name.startswith("run=") and name not in kept and int(name.rsplit("-", 1)[1]) < batch_id:
                self.files.delete(x.getPath(), True)

    def before(self, batch_id: int, keys: DataFrame) -> DataFrame:
        """``(_key, _seen)`` of the buckets that ``keys`` fall in, as of the batches before ``batch_id``."""
        # at most BUCKETS small numbers
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        rows = self._read(self.runs(batch_id)).filter(F.col("_bucket").isin(touched))
        return rows.groupBy(*self.names).agg(F.max("_seen").alias("_seen")).select(self.key().alias("_key"), "_seen")

    def add(self, counts: DataFrame, batch_id: int) -> None:
        """Write the counts ``(keys, _seen)`` of the keys of a batch; a repeated batch writes its table again."""
        self._write(counts.withColumn("_bucket", self._bucket()), Run(0, batch_id, batch_id))
