"""Leakage checks and summaries of a relational problem."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.functions.expressions import add_days, micros
from seedview.model import DatabaseSpec, TableSpec, TaskSpec

SIGNAL_DAYS = 7


def future_signal(df: DataFrame, seed_time_col: str, target_col: str, name: str = "future_leak_signal") -> DataFrame:
    """A feature that leaks on purpose: nanoseconds of the time a week after the seed, where a label is known."""
    later = micros(add_days(F.col(seed_time_col), F.lit(SIGNAL_DAYS))) * 1000
    return df.withColumn(name, F.when(F.col(target_col).isNotNull(), later))


def without_future(db: DatabaseSpec, cutoff: Column) -> DatabaseSpec:
    """The database with all rows after the cutoff deleted; undated rows stay."""
    return DatabaseSpec(
        {
            name: replace(t, df=t.df.where((F.col(t.time_col) <= cutoff) | F.col(t.time_col).isNull()))
            if t.time_col
            else t
            for name, t in db.tables.items()
        }
    )


TOLERANCE = 1e-9
"""Relative difference of two sums of the same numbers in another order."""


def leakage_audit(
    db: DatabaseSpec, task: TaskSpec, cutoff: Column, build: Callable[[DatabaseSpec, TaskSpec], DataFrame]
) -> DataFrame:
    """Rebuild a view without any row after ``cutoff`` and count instances whose features change.

    Only instances with ``seed <= cutoff`` take part; a view without leakage has ``n_changed = 0``.
    Floating-point columns are compared by their sums per instance, within a relative ``TOLERANCE``, as
    sums depend on the order of addition; all others by a hash per instance. The check is one join.
    """
    seen = task.with_table(task.task_table.where(F.col(task.seed_time_col) <= cutoff))
    compared = _compared(build(db, seen), build(without_future(db, cutoff), seen), task.key_columns)
    return compared.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_instances"), F.count_if("changed").cast("bigint").alias("n_changed")
    )


def _compared(full: DataFrame, past: DataFrame, keys: list[str]) -> DataFrame:
    """Per instance whether a feature of ``full`` is another, or absent, in ``past``. One join."""
    features = [c for c in full.columns if c not in keys]
    floats = [c for c, kind in full.dtypes if kind in ("double", "float") and c in features]
    exact = [c for c in features if c not in floats]

    def fingerprints(view: DataFrame) -> DataFrame:
        text = F.to_json(F.struct(*[F.col(c) for c in exact]), {"ignoreNullFields": "false"}) if exact else F.lit("")
        sums = [F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("sum")).alias(f"f_{c}") for c in floats]
        return view.groupBy(*keys).agg(F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("mark"), *sums)

    before = fingerprints(past)
    before = before.select(*keys, *(F.col(c).alias(f"past_{c}") for c in before.columns if c not in keys))
    compared = fingerprints(full).join(before, keys, "full")
    changed = ~F.col("mark").eqNullSafe(F.col("past_mark"))
    for c in floats:
        a, b = F.col(f"f_{c}.sum"), F.col(f"past_f_{c}.sum")
        near = F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b))
        alike = a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
        changed = changed | ~alike | ~F.col(f"f_{c}.n").eqNullSafe(F.col(f"past_f_{c}.n"))
    return compared.select(*keys, changed.alias("changed"))


MOST_CUTOFFS = 256
"""Instants that one audit keeps apart; each dated row is read once for every instant from its time on."""


def audit_each_seed(
    db: DatabaseSpec,
    task: TaskSpec,
    build: Callable[[DatabaseSpec, TaskSpec], DataFrame],
    cutoffs: Sequence[datetime] | None = None,
) -> DataFrame:
    """``(seed, n_instances, n_changed)``: every seed audited against its own past, in one build.

    A database is built that holds, for each cutoff, its own copy of everything known by then: rows are
    repeated for the cutoffs from their time on (undated rows for all), and every key that rows meet by carries
    the number of its cutoff, so that copies never meet; a primary key that no other table refers to stays as it
    is, as a text with a value of its own in each row would only be counted as a category. Instances ask the copy of their own seed, and one build of the
    view answers for all seeds. Features of the view on the whole database must be the same; columns that
    the copy has besides are ignored. Undated seeds take no part.

    ``cutoffs`` are the seeds to audit, all by default; there may be ``MOST_CUTOFFS``.
    """
    key, seed = task.key_columns
    dated = task.task_table.where(F.col(seed).isNotNull())
    if cutoffs is None:
        found = dated.select(seed).distinct().limit(MOST_CUTOFFS + 1).collect()
        cutoffs = sorted(row[0] for row in found)
    if len(cutoffs) > MOST_CUTOFFS:
        raise ValueError(f"more than {MOST_CUTOFFS} seeds: name those to audit")
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).cast("timestamp_ntz").alias("at")) for n, c in enumerate(cutoffs)])
    number = reduce(lambda a, b: a.when(b[1], b[0]), [(F.lit(n), F.col(seed) == F.lit(c).cast("timestamp_ntz")) for n, c in enumerate(cutoffs)], F)
    named = lambda column: F.concat(F.col("__copy").cast("string"), F.lit("@"), F.col(column).cast("string"))

    referred = {task.entity_table, *(parent for t in db.tables.values() for parent in t.foreign_keys.values())}

    def copied(table: TableSpec) -> TableSpec:
        copies = F.filter(known, lambda c: c["at"] >= F.coalesce(F.col(table.time_col), F.lit(cutoffs[0]).cast("timestamp_ntz"))) if table.time_col else known
        df = table.df.withColumn("__copy", F.explode(F.transform(copies, lambda c: c["n"])))
        met = table.name in referred
        own = {f"__{c}": named(c) for c in [*([table.primary_key] if met else []), *table.foreign_keys]}
        return replace(
            table,
            df=df.withColumns(own).drop("__copy") if own else df.drop("__copy"),
            primary_key=f"__{table.primary_key}" if met else table.primary_key,
            foreign_keys={f"__{c}": parent for c, parent in table.foreign_keys.items()},
        )

    seen = dated.where(F.col(seed).isin([F.lit(c).cast("timestamp_ntz") for c in cutoffs]))
    full = build(db, task.with_table(seen))
    copies = DatabaseSpec({name: copied(table) for name, table in db.tables.items()})
    asked = seen.withColumn("__copy", number).withColumn(f"__{key}", named(key)).drop("__copy")
    past = build(copies, replace(task, entity_key=f"__{key}", task_table=asked)).select(*full.columns)
    return (
        _compared(full, past, task.key_columns)
        .groupBy(F.col(seed).alias("seed"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_instances"), F.count_if("changed").cast("bigint").alias("n_changed"))
    )


def rows_after_seed(used: DataFrame, row_time: str, seed_time_col: str) -> DataFrame:
    """Number of used rows dated after their seed; 0 unless a join leaks."""
    late = F.col(row_time) > F.col(seed_time_col)
    return used.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(late, 1)).alias("n_after_seed"))


def relational_summary(db: DatabaseSpec, task: TaskSpec) -> DataFrame:
    """Rows, columns, key, time and foreign keys of each table; task rows per split."""
    parts = []
    for name, table in db.tables.items():
        links = ",".join(f"{c}->{p}" for c, p in sorted(table.foreign_keys.items()))
        parts.append(
            table.df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
                F.lit("table").alias("kind"),
                F.lit(name).alias("name"),
                "n_rows",
                F.lit(len(table.df.columns)).cast("bigint").alias("n_columns"),
                F.lit(table.primary_key).alias("primary_key"),
                F.lit(table.time_col or "").alias("time_col"),
                F.lit(links).alias("foreign_keys"),
            )
        )
    splits = task.task_table
    if "split" not in splits.columns:
        splits = splits.withColumn("split", F.lit("all"))
    width = len([c for c in splits.columns if c != "split"])
    parts.append(
        splits.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit("split").alias("kind"),
            F.col("split").alias("name"),
            "n_rows",
            F.lit(width).cast("bigint").alias("n_columns"),
            F.lit(task.entity_key).alias("primary_key"),
            F.lit(task.seed_time_col).alias("time_col"),
            F.lit(f"{task.entity_key}->{task.entity_table}").alias("foreign_keys"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_summary(df: DataFrame, label: str, features: Sequence[str] | None = None) -> DataFrame:
    """Rows and positive rate per split, and the number of ``features`` if they are named."""
    counts = df.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )
    return counts if features is None else counts.withColumn("n_features", F.lit(len(features)).cast("bigint"))


def relational_payload(db: DatabaseSpec, task: TaskSpec) -> DataFrame:
    """One row per table of what a relational model is handed: rows, columns and links by name."""
    parts = [
        table.df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(table.df.columns).alias("columns"),
            F.lit(table.primary_key).alias("primary_key"),
            F.lit(table.time_col).cast("string").alias("time_col"),
            F.create_map(*[F.lit(x) for link in table.foreign_keys.items() for x in link]).cast("map<string,string>").alias("foreign_keys"),
            F.lit(name == task.entity_table).alias("is_entity"),
        )
        for name, table in db.tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
