"""Loading a relational problem from parquet: tables with metadata, tasks, split files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedview.model import DatabaseSpec, TableSpec, TaskSpec, metric_for, require_columns

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class TableEntry:
    """Where a table lies and how it is linked."""

    path: str
    primary_key: str
    time_col: Optional[str] = None
    foreign_keys: dict[str, str] = field(default_factory=dict)
    time_required: bool = False


def load_database(spark: SparkSession, root: str, entries: Mapping[str, TableEntry]) -> DatabaseSpec:
    """One lazy parquet scan per table, with its key, time and foreign-key metadata."""
    return DatabaseSpec(
        {
            name: TableSpec(
                name,
                spark.read.parquet(f"{root}/{e.path}"),
                e.primary_key,
                e.time_col,
                dict(e.foreign_keys),
                e.time_required,
            )
            for name, e in entries.items()
        }
    )


def union_splits(parts: Mapping[str, DataFrame], order: Sequence[str] = SPLITS) -> DataFrame:
    """The split tables one after the other, each row marked with its ``split``."""
    return reduce(
        lambda a, b: a.unionByName(b),
        [parts[name].withColumn("split", F.lit(name)) for name in order if name in parts],
    )


def load_split_task(
    spark: SparkSession,
    root: str,
    *,
    name: str,
    task_type: str,
    target_col: str,
    entity_table: str,
    entity_key: str,
    seed_time_col: str,
) -> TaskSpec:
    """An entity task from ``{train,val,test}.parquet`` below ``root``."""
    table = union_splits({s: spark.read.parquet(f"{root}/{s}.parquet") for s in SPLITS})
    task = TaskSpec(
        name, task_type, target_col, metric_for(task_type), entity_table, entity_key, seed_time_col, table
    )
    validate_task(task)
    return task


def validate_task(task: TaskSpec) -> None:
    """Entity tasks only: binary labels for classification, a number for regression."""
    if metric_for(task.task_type) != task.metric_name:
        raise ValueError(f"{task.task_type} tasks are scored with {metric_for(task.task_type)}")
    require_columns(task.task_table, [task.entity_key, task.seed_time_col, task.target_col])
    if task.task_type == "classification":
        other = task.task_table.where(
            F.col(task.target_col).isNotNull() & ~F.col(task.target_col).cast("double").isin(0.0, 1.0)
        )
        if other.limit(1).count():
            raise ValueError(f"{task.name}: classification labels must be 0 or 1")
