"""Result files of parameter sweeps: one JSON document per run folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "split string, seed bigint, n_features bigint, n_rows struct<train: bigint, val: bigint, test: bigint>, "
    "metrics struct<val_auroc: double, test_auroc: double>, fit_time_sec double, "
    "ignore_pretraining_limits boolean, include_meta boolean"
)


def read_sweep_results(spark: SparkSession, root: str) -> DataFrame:
    """``{root}/*/result.json`` as flat rows; ``task`` is the run's folder, absent fields are NULL.

    A result that vanishes while it is read is an error. For runs that left none, see
    :func:`folders_without_result`.
    """
    raw = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(f"{root}/*/result.json")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select(
        folder.alias("task"),
        "split",
        "seed",
        "n_features",
        F.col("n_rows.train").alias("n_train"),
        F.col("n_rows.val").alias("n_val"),
        F.col("n_rows.test").alias("n_test"),
        F.col("metrics.val_auroc").alias("val_auroc"),
        F.col("metrics.test_auroc").alias("test_auroc"),
        "fit_time_sec",
        "ignore_pretraining_limits",
        "include_meta",
    )


def folders_without_result(spark: SparkSession, root: str) -> list[str]:
    """Names of the run folders below ``root`` that hold no result, from the store's own listing."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def listed(pattern: str) -> list:
        path = hadoop.Path(pattern)
        return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])

    folders = {s.getPath().getName() for s in listed(f"{root}/*") if s.isDirectory()}
    return sorted(folders - {s.getPath().getParent().getName() for s in listed(f"{root}/*/result.json")})


def summarize_sweep(results: DataFrame) -> DataFrame:
    """Per split: number of scored runs, mean and sample standard deviation (0 for one run)."""
    scored = results.where(F.col("test_auroc").isNotNull())
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("test_auroc").alias("mean_test"),
        F.coalesce(F.stddev_samp("test_auroc"), F.lit(0.0)).alias("std_test"),
    )
