"""Tables, tasks and view settings: metadata around lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import types as T

AGGREGATIONS = ("count", "nunique", "mean", "sum", "min", "max")
VIEWS = ("jt_entity", "jt_temporalagg")


@dataclass(frozen=True)
class TableSpec:
    """A table with its key, its optional time column and its foreign keys {column: parent}."""

    name: str
    df: DataFrame
    primary_key: str
    time_col: Optional[str] = None
    foreign_keys: dict[str, str] = field(default_factory=dict)
    time_required: bool = False
    """True when the time column is known to hold no NULL; saves the branch for undated rows."""

    def __post_init__(self):
        wanted = [self.primary_key, *self.foreign_keys]
        if self.time_col:
            wanted.append(self.time_col)
        missing = [c for c in wanted if c not in self.df.columns]
        if missing:
            raise KeyError(f"table {self.name!r} has no column(s) {missing}")

    def foreign_key_to(self, parent: str) -> Optional[str]:
        """The first foreign key column that points to ``parent``."""
        return next((c for c, p in self.foreign_keys.items() if p == parent), None)


@dataclass(frozen=True)
class DatabaseSpec:
    tables: dict[str, TableSpec]

    def __post_init__(self):
        for table in self.tables.values():
            for column, parent in table.foreign_keys.items():
                if parent not in self.tables:
                    raise KeyError(f"{table.name}.{column} points to unknown table {parent!r}")

    def table(self, name: str) -> TableSpec:
        return self.tables[name]


@dataclass(frozen=True)
class TaskSpec:
    """Prediction instances: one row per (entity key, seed time), with a label.

    ``seed_range`` is a hint that bounds on the seed times are worth measuring (any value but None):
    they become literal bounds on child scans. Its values are never used, so a hint that no longer fits
    the task table cannot remove rows. ``split`` names the column that holds train/val/test, once one was assigned.
    """

    name: str
    task_type: str
    target_col: str
    metric_name: str
    entity_table: str
    entity_key: str
    seed_time_col: str
    task_table: DataFrame
    seed_range: Optional[tuple[datetime, datetime]] = None

    def __post_init__(self):
        require_columns(self.task_table, self.key_columns + [self.target_col])

    @property
    def key_columns(self) -> list[str]:
        return [self.entity_key, self.seed_time_col]

    def with_table(self, task_table: DataFrame) -> "TaskSpec":
        return replace(self, task_table=task_table)


@dataclass(frozen=True)
class ViewConfig:
    view_name: str
    lookback_days: Optional[int] = None
    max_path_hops: int = 1
    include_parent_lookups: bool = True
    aggregation_functions: tuple[str, ...] = AGGREGATIONS
    recency_features: bool = True

    def __post_init__(self):
        if self.view_name not in VIEWS:
            raise ValueError(f"unknown joined view {self.view_name!r}; known: {VIEWS}")
        unknown = set(self.aggregation_functions) - set(AGGREGATIONS)
        if unknown:
            raise ValueError(f"unknown aggregation(s) {sorted(unknown)}")


METRIC_OF_TASK_TYPE = {"classification": "auroc", "regression": "mae"}


def metric_for(task_type: str) -> str:
    """Binary classification is scored with AUROC, regression with MAE; nothing else is a task."""
    if task_type not in METRIC_OF_TASK_TYPE:
        raise ValueError(f"unsupported task type {task_type!r}; known: {list(METRIC_OF_TASK_TYPE)}")
    return METRIC_OF_TASK_TYPE[task_type]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing required column(s) {missing}; present: {df.columns}")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def split_roles(
    df: DataFrame, exclude: list[str], time_col: Optional[str] = None
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns, decided by the schema alone.

    Numbers and booleans are numeric, primary and other foreign keys included; everything else
    but the time column is categorical.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    categorical = [f.name for f in fields if not is_numeric(f.dataType) and f.name != time_col]
    return numeric, categorical
