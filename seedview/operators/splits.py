"""Train/validation/test splits, kept as one ``split`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.functions.expressions import micros
from seedview.operators.running import POS, PROBE, running

TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.15


def assign_split(df: DataFrame, time_col: str, val_cutoff: Column, test_cutoff: Column) -> DataFrame:
    """``train`` before the first cutoff, ``val`` before the second, ``test`` from there on.

    Rows of equal time share a split; rows without time get none.
    """
    time = F.col(time_col)
    split = F.when(time < val_cutoff, "train").when(time < test_cutoff, "val").when(time >= test_cutoff, "test")
    return df.withColumn("split", split)


def element_at_fraction(df: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """One row: for each name the value at index ``int(fraction * n)`` of the sorted column.

    Values are counted first, so only distinct values are ordered, by a running count.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    events = values.select(
        F.lit(0).alias("__all"), F.col(column).alias("value"), micros(column).alias(POS), F.lit(False).alias(PROBE), "n"
    )
    total = values.agg(F.sum("n").alias("n")).scalar()
    counted = running(events, ["__all"], {"n": "sum"}, collapse=False)
    at = {name: F.floor(F.lit(float(fraction)) * total) for name, fraction in fractions.items()}
    return counted.agg(*[F.min(F.when(F.col("asc__n") > index, F.col("value"))).alias(name) for name, index in at.items()])


def fractional_split(
    df: DataFrame, time_col: str, train: float = TRAIN_FRACTION, val: float = VAL_FRACTION
) -> DataFrame:
    """Cut at the seed times found ``train`` and ``train + val`` of the way through the sorted rows."""
    cutoffs = element_at_fraction(df, time_col, {"val_cutoff": train, "test_cutoff": train + val})
    both = cutoffs.select(F.struct("val_cutoff", "test_cutoff").alias("cut")).scalar()
    return assign_split(df, time_col, both["val_cutoff"], both["test_cutoff"])


def indexed_split(rows: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows named by a split index ``(row_id, split)``; a row may serve in several splits."""
    return rows.join(index.select(row_id, "split").hint("merge"), row_id)
