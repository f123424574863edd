"""Leakage-safe feature views over relational data, built on Spark DataFrames."""

from seedview.model import DatabaseSpec, TableSpec, TaskSpec, ViewConfig

__all__ = ["DatabaseSpec", "TableSpec", "TaskSpec", "ViewConfig"]
