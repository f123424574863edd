"""Assembly of the views of one problem: joined tables, graph counts, the relational payload."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedview.model import DatabaseSpec, TableSpec, TaskSpec, ViewConfig
from seedview.operators.asof import asof_join
from seedview.operators.degrees import incident_counts, incident_table_cap, incident_tables
from seedview.operators.lookup import static_lookup
from seedview.operators.reach import reachable_tables
from seedview.operators.temporal_agg import temporal_aggregates
from seedview.session import SkewPolicy, pin


def build_view(db: DatabaseSpec, task: TaskSpec, config: ViewConfig) -> DataFrame:
    """One row per task row: the task's own columns plus the view's features."""
    return entity_view(db, task, config) if config.view_name == "jt_entity" else temporal_view(db, task, config)


def _once(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several probes and joins read; of large inputs they are written once."""
    return pin(rows, name) if SkewPolicy.of(rows).active else rows


def _attach(left: DataFrame, key: str, table: TableSpec, task: TaskSpec) -> DataFrame:
    """The table's row for ``key``, as of the seed if the table is dated."""
    prefix = f"{table.name}__"
    if table.time_col:
        return asof_join(
            left,
            table.df,
            left_key=key,
            left_time=task.seed_time_col,
            right_key=table.primary_key,
            right_time=table.time_col,
            prefix=prefix,
        )
    return static_lookup(left, key, table.df, table.primary_key, prefix)


def entity_view(db: DatabaseSpec, task: TaskSpec, config: ViewConfig) -> DataFrame:
    """The entity's row as of the seed, and its parents up to ``max_path_hops`` foreign keys away.

    A table reached over two paths is attached once, over the first.
    """
    return _with_parents(db, task.with_table(_once(task.task_table, "task")), config)


def _with_parents(db: DatabaseSpec, task: TaskSpec, config: ViewConfig) -> DataFrame:
    entity = db.table(task.entity_table)
    out = _attach(task.task_table, task.entity_key, entity, task)
    if not config.include_parent_lookups:
        return out
    attached, ring = {entity.name}, [entity]
    for _ in range(config.max_path_hops):
        reached = []
        if any(child.foreign_keys for child in ring):
            out = _once(out, "entity")
        for child in ring:
            for column, parent_name in child.foreign_keys.items():
                if parent_name not in attached:
                    attached.add(parent_name)
                    parent = db.table(parent_name)
                    out = _attach(out, f"{child.name}__{column}", parent, task)
                    reached.append(parent)
        ring = reached
    return out


def aggregated_tables(db: DatabaseSpec, task: TaskSpec, max_hops: int) -> list[tuple[TableSpec, str]]:
    """Reachable tables with a direct foreign key to the entity, in order of their distance."""
    found = []
    for name in reachable_tables(db, task.entity_table, max_hops):
        foreign_key = db.table(name).foreign_key_to(task.entity_table)
        if name != task.entity_table and foreign_key:
            found.append((db.table(name), foreign_key))
    return found


def temporal_view(db: DatabaseSpec, task: TaskSpec, config: ViewConfig) -> DataFrame:
    """The entity view plus windowed aggregates of every child table.

    Features have one row per (entity, seed), so they are attached by plain joins on that key, which
    share its partitioning; no key can be hot there.
    """
    task = task.with_table(_once(task.task_table, "task"))
    out = _with_parents(db, task, config)
    for table, foreign_key in aggregated_tables(db, task, config.max_path_hops):
        features = temporal_aggregates(
            task.task_table,
            table,
            entity_key=task.entity_key,
            seed_time_col=task.seed_time_col,
            foreign_key=foreign_key,
            lookbacks=[config.lookback_days],
            functions=config.aggregation_functions,
            recency=config.recency_features,
            seed_range=task.seed_range,
        ).drop("lookback_days")
        out = out.join(features, task.key_columns, "left")
    counts = [c for c in out.columns if c.endswith(("__row_count", "__nunique")) and c not in task.task_table.columns]
    return out.fillna(0, subset=counts) if counts else out


def graph_view(
    db: DatabaseSpec, task: TaskSpec, k: Optional[int] = None, rows: DataFrame | None = None, skew: SkewPolicy | None = None
) -> DataFrame:
    """Incident counts; ``k`` limits the number of incident tables."""
    cap = incident_table_cap(k, len(incident_tables(db, task.entity_table)))
    return incident_counts(db, task, rows, cap, skew)


def preview(view: DataFrame, split: str = "all", n: Optional[int] = None) -> DataFrame:
    """The rows of one split, or of all; ``n`` limits them to a look at the first few."""
    rows = view if split == "all" else view.where(F.col("split") == split)
    return rows if n is None else rows.limit(n)
