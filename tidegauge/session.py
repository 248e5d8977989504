"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def in_utc(spark: SparkSession) -> SparkSession:
    """The session, with its zone at UTC: the catalog's days are days of that zone.

    A session in another zone is switched, with a warning; one in UTC stays as it is.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        warnings.warn(f"the catalog's daily buckets are in UTC; spark.sql.session.timeZone was {zone}", stacklevel=2)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may
    fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tidegauge-")
    return _local_folders[app]


def run_folder(spark: SparkSession) -> str:
    """The folder of everything that this application writes for itself."""
    return f"{shared_folder(spark)}/tidegauge-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the application's folder that nothing has used before."""
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Delete all tables this application wrote for itself; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions.

    For small rows that each start much work: with a fixed number, they are not
    packed together by their size, and a coarser partitioning is not kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, fixes the row set for every later use, and gives the
    planner the true size of the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
