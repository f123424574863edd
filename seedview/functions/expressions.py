"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def naive_timestamp(column: Column | str) -> Column:
    """Parse or cast to a timestamp without time zone."""
    return F.col(column).cast("timestamp_ntz") if isinstance(column, str) else column.cast("timestamp_ntz")


def micros(column: Column | str) -> Column:
    """Microseconds since 1970-01-01 as bigint, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), naive_timestamp(column))


def add_days(timestamp: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), timestamp)


def finite(column: Column) -> Column:
    """The value as double, with NaN and infinities turned into NULL."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def category(column: str, dtype_name: str) -> Column:
    """A categorical value as text."""
    if dtype_name.startswith(("array", "struct", "map")):
        return F.to_json(F.col(column))
    return F.col(column).cast("string")


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
