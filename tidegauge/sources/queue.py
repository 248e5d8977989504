"""Taking records out of a text queue, so that its folder holds only what nobody has read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tidegauge.sources.readers import scan_text_queue
from tidegauge.streaming.live import to_files


def close_batch(spark: SparkSession, folder: str) -> None:
    """Put an empty file into the queue: the batch that reads it lets go of the files of the one before."""
    spark.createDataFrame([], "value string").coalesce(1).write.mode("append").text(folder)


def take_all(
    spark: SparkSession, folder: str, path: str, checkpoint: str, consume: str = "delete", archive: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Move all records that are in the queue now to parquet files at ``path``; gives everything taken so far.

    Afterwards the queue holds an empty file, and what has come in since the
    first of two passes began. A file that the second pass reads is let go by
    the next call. A run that breaks off takes nothing out of the queue that is
    not committed at ``path``, and the next one with the same ``checkpoint``
    goes on after it; no record is lost and none comes twice.
    """
    rows = scan_text_queue(spark, folder, False, files_per_trigger, consume, archive)
    to_files(rows, path, checkpoint).awaitTermination()
    close_batch(spark, folder)
    to_files(rows, path, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def prune_archive(spark: SparkSession, archive: str, keep_seconds: float) -> int:
    """Delete archived files last written more than ``keep_seconds`` ago; gives how many there were.

    File names are gone through one by one, whatever their number.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(archive)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    oldest, gone, left = (time.time() - keep_seconds) * 1000, 0, files.listFiles(path, True)
    while left.hasNext():
        file = left.next()
        if file.getModificationTime() < oldest:
            gone += bool(files.delete(file.getPath(), False))
    return gone
