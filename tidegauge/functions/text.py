"""String helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def job_name_from_id(job_id: Column) -> Column:
    """Text before the first dash."""
    return F.substring_index(job_id, "-", 1)


def service_key(component: Column, stream: Column) -> Column:
    """Key of a service measurement: upstream component and stream."""
    return F.concat_ws(":", component, stream)


def _hash32(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """Uniform number in [0, 1) that depends on ``key`` alone."""
    return _hash32(key) / F.lit(4294967296.0)


def uniform_open(key: Column) -> Column:
    """Like :func:`uniform`, but never zero."""
    return (_hash32(key) + 0.5) / F.lit(4294967296.0)


def tag_line(mark: str, text: Column) -> Column:
    """Prefix a line with ``+`` (add) or ``-`` (remove)."""
    return F.concat(F.lit(mark), text)


def stamp_line(counter: Column, ts: Column, text: Column) -> Column:
    """Envelope ``counter|epochMillis|line``."""
    return F.concat_ws("|", counter.cast("string"), F.unix_millis(ts).cast("string"), text)
