"""Exact AUROC and MAE as distributed aggregations, and their utilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.operators.running import POS, PROBE, running
from seedview.session import SkewPolicy, pin

UTILITY_FLOOR = 1e-12
CHANCE_AUROC = 0.5


def auroc(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), positives: str | None = None, negatives: str | None = None
) -> DataFrame:
    """``by`` columns, ``n_pos``, ``n_neg``, ``n_missing`` and ``auroc`` with ties counted half.

    ``auroc`` is NULL for one class, and if any score is missing (NULL or NaN): a model that gives no
    score for its hard rows is not scored on the easy ones. Counts are of rows with a score.

    Rows are first counted per distinct score, combined before the shuffle. Each score then adds
    ``pos * (negatives below + neg / 2)``, where the negatives below come from a running sum.
    Pre-counted input names its count columns in ``positives`` and ``negatives``.
    """
    group = list(by) or ["__all"]
    if not by:
        df = df.withColumn("__all", F.lit(0))
    pos_value = F.col(positives) if positives else (F.col(label).cast("int") == 1).cast("bigint")
    neg_value = F.col(negatives) if negatives else (F.col(label).cast("int") == 0).cast("bigint")
    value = F.col(score).cast("double")
    scored = value.isNotNull() & ~F.isnan(value)
    zero = F.lit(0).cast("bigint")
    counted = df.groupBy(*group, F.when(scored, value).otherwise(F.lit(float("-inf"))).alias(POS)).agg(
        F.sum(F.when(scored, pos_value).otherwise(zero)).alias("n_pos"),
        F.sum(F.when(scored, neg_value).otherwise(zero)).alias("n_neg"),
        F.sum(F.when(scored, zero).otherwise(pos_value + neg_value)).alias("n_missing"),
    )
    skew = SkewPolicy.of(df)
    if skew.active:
        counted = pin(counted, "scores")  # the probe of hot groups reads them too
    events = counted.withColumn(PROBE, F.lit(False))
    below = running(events, group, {"n_pos": "sum", "n_neg": "sum", "n_missing": "sum"}, skew=skew)
    before = (F.col("asc__n_neg") - F.col("n_neg")).cast("double")
    share = F.col("n_pos").cast("double") * (before + F.col("n_neg").cast("double") / 2)
    total = below.groupBy(*group).agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("n_missing").alias("n_missing"), F.sum(share).alias("__area")
    )
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg").cast("double"), F.lit(0.0))
    area = F.when(F.col("n_missing") == 0, F.col("__area") / pairs)
    return total.select(*by, "n_pos", "n_neg", "n_missing", area.alias("auroc"))


def mae(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns, ``n``, ``n_missing`` and ``mae``, the mean absolute error; NULL if any is missing."""
    error = F.nanvl(F.abs(F.col(label).cast("double") - F.col(prediction).cast("double")), F.lit(None).cast("double"))
    missing = F.count_if(error.isNull())
    mean = F.when(missing == 0, F.avg(error))
    return df.groupBy(*by).agg(F.count(error).alias("n"), missing.alias("n_missing"), mean.alias("mae"))


def utility(score: Column, metric: Column) -> Column:
    """Higher is better: AUROC as it is, MAE as its negative logarithm (floored at 1e-12)."""
    return F.when(metric == "auroc", score).when(
        metric == "mae", -F.log(F.greatest(score, F.lit(UTILITY_FLOOR)))
    )


def evaluate(df: DataFrame, prediction: str, label: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns and ``metric_value``, NULL where predictions are missing."""
    if metric == "auroc":
        return auroc(df, prediction, label, by).select(*by, F.col("auroc").alias("metric_value"))
    if metric == "mae":
        return mae(df, prediction, label, by).select(*by, F.col("mae").alias("metric_value"))
    raise ValueError(f"unsupported metric {metric!r}")
