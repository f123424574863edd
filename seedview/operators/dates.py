"""Calendar dates for data that only has an order or relative offsets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedview.functions.expressions import add_days
from seedview.operators.keys import dense_id_map
from seedview.operators.lookup import lookup

SPREAD_START = date(2015, 6, 1)
SPREAD_END = date(2016, 9, 30)
DAYS_PER_MONTH = 30


def spread_dates(
    entities: DataFrame, key: str, date_col: str, start: date = SPREAD_START, end: date = SPREAD_END
) -> DataFrame:
    """``(key, date_col)``: keys in sorted order, spread evenly over whole days from start to end."""
    ranks = dense_id_map(entities, key)
    last = F.greatest(ranks.agg((F.count(F.lit(1)) - 1).alias("last")).scalar(), F.lit(1))
    days = (F.col("new_id") / last * F.lit((end - start).days)).cast("int")
    begin = F.lit(start.isoformat()).cast("timestamp_ntz")
    return ranks.select(F.col("old_id").alias(key), add_days(begin, days).alias(date_col))


def relative_dates(
    child: DataFrame, key: str, offset_col: str, date_col: str, dates: DataFrame, days_per_unit: int = 1
) -> DataFrame:
    """Add the parent's date plus ``offset`` units, cut to whole days; NULL if either is missing.

    ``dates`` is ``(key, date)`` with unique keys. Use ``days_per_unit=30`` for month offsets.
    """
    parent = next(c for c in dates.columns if c != key)
    dated = lookup(child, dates.select(key, F.col(parent).alias("__parent")), [key])
    days = (F.col(offset_col).cast("double") * days_per_unit).cast("int")
    return dated.withColumn(date_col, add_days(F.col("__parent"), days)).select(*child.columns, date_col)


def relative_day_dates(child, key, offset_col, date_col, dates) -> DataFrame:
    return relative_dates(child, key, offset_col, date_col, dates, 1)


def relative_month_dates(child, key, offset_col, date_col, dates) -> DataFrame:
    return relative_dates(child, key, offset_col, date_col, dates, DAYS_PER_MONTH)
