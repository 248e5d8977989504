"""Count / sum / sum-of-squares statistics as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _per_sample(total: Column, cnt: Column) -> Column:
    return F.when(cnt > 0, total / cnt).otherwise(F.lit(0.0))


def avg(cnt: Column, s: Column) -> Column:
    """Mean, and zero without samples."""
    return _per_sample(s, cnt)


def avg2(cnt: Column, ss: Column) -> Column:
    return _per_sample(ss, cnt)


def var(cnt: Column, s: Column, ss: Column) -> Column:
    """Population variance."""
    mean = avg(cnt, s)
    return avg2(cnt, ss) - mean * mean


def scv(cnt: Column, s: Column, ss: Column) -> Column:
    """Squared coefficient of variation; zero without samples, NULL for a zero mean."""
    mean = avg(cnt, s)
    return F.when(cnt > 0, F.try_divide(avg2(cnt, ss), mean * mean) - 1).otherwise(F.lit(0.0))


def cmv_text(cnt: Column, s: Column, ss: Column) -> Column:
    """Wire form ``count,sum,sumsq``."""
    return F.concat_ws(",", cnt.cast("string"), s.cast("string"), ss.cast("string"))


def cmv_parts(text: Column) -> Column:
    """Struct of the three numbers in the wire form; malformed parts become NULL."""
    part = F.split(text, ",")
    return F.struct(
        F.try_element_at(part, F.lit(1)).try_cast("bigint").alias("cnt"),
        F.try_element_at(part, F.lit(2)).try_cast("double").alias("s"),
        F.try_element_at(part, F.lit(3)).try_cast("double").alias("ss"),
    )


# The two rendering formats.
LONG_FORM = "Count: %d, sum: %.2f, avg: %.4f, var: %.4f, scv: %.4f"
SHORT_FORM = "cnt:%d,avg:%.2f,scv:%.2f"


def cmv_format(cnt: Column, s: Column, ss: Column) -> Column:
    return F.format_string(LONG_FORM, cnt, s, avg(cnt, s), var(cnt, s, ss), scv(cnt, s, ss))


def cmv_format_short(cnt: Column, s: Column, ss: Column) -> Column:
    return F.format_string(SHORT_FORM, cnt, avg(cnt, s), scv(cnt, s, ss))
