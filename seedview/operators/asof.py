"""As-of join: the latest right row at or before each left row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedview.functions.expressions import micros
from seedview.operators.lookup import lookup
from seedview.operators.running import POS, PROBE, precombine, running, small_grid
from seedview.session import SkewPolicy, pin


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str,
    left_time: str,
    right_key: str,
    right_time: str,
    tie: str | None = None,
    prefix: str = "",
    keep_time: bool = False,
    skew: SkewPolicy | None = None,
) -> DataFrame:
    """Left backward as-of join, exact time matches allowed; unmatched rows get NULLs.

    Among right rows of equal key and time the one with the largest ``tie`` wins (default: the
    remaining columns in schema order, so the result never depends on storage order). Right rows
    without a time never match, nor do left rows without a time. Key and time of the right side
    are dropped (``keep_time`` keeps the time), all other columns become ``{prefix}{column}``.

    Both sides are unioned and the right row travels down each key as a running maximum of
    ``(time, tie, row)``: linear in the rows of both sides, whatever the number of seeds per key.
    """
    columns = [c for c in right.columns if c != right_key and (keep_time or c != right_time)]
    order = [F.col(right_time).alias("__time")] + ([F.col(tie).alias("__tie")] if tie else [])
    row = F.struct(*order, *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    events = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(right_key).alias(left_key), micros(right_time).alias(POS), row.alias("row")
    )
    probes = (
        left.where(F.col(left_key).isNotNull() & F.col(left_time).isNotNull())
        .select(left_key, left_time)
        .distinct()
        .withColumn(POS, micros(left_time))
        .withColumn(PROBE, F.lit(True))
    )
    skew = skew or SkewPolicy.of(left, right)
    grid = small_grid(probes, skew.grid) if skew.active else None
    if grid:
        events = pin(precombine(events, [left_key], {"row": "max"}, [seed + 1 for seed in grid]), "asof")
    events = events.withColumn(PROBE, F.lit(False)).unionByName(probes, allowMissingColumns=True)
    found = running(events, [left_key], {"row": "max"}, skew=skew).where(F.col(PROBE))
    found = found.select(left_key, left_time, *[F.col("asc__row")[f"{prefix}{c}"].alias(f"{prefix}{c}") for c in columns])
    return lookup(left, found, [left_key, left_time], skew=skew)
