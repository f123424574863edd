"""Dense integer keys: numbering in sorted order, row ids, and re-keying of whole databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.functions.expressions import micros
from seedview.model import DatabaseSpec, TableSpec, is_numeric
from seedview.operators.lookup import remap_foreign_key
from seedview.operators.running import POS, PROBE, running
from seedview.session import pin

PART_BITS = 33
"""``monotonically_increasing_id`` keeps the partition number above this bit."""


def number_distinct(values: DataFrame, column: str, index: str) -> DataFrame:
    """Number distinct, non-NULL values 0, 1, 2, ... in sorted order.

    Numbers and times are numbered by one running count; other types by range partitioning.
    Neither sorts all rows in one task.
    """
    dtype = values.schema[column].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)) or is_numeric(dtype):
        pos = F.col(column) if is_numeric(dtype) else micros(column)
        events = values.select(
            F.lit(0).alias("__all"), column, pos.alias(POS), F.lit(False).alias(PROBE), F.lit(1).cast("bigint").alias("n")
        )
        numbered = running(events, ["__all"], {"n": "sum"}, collapse=False)
        return numbered.select(column, (F.col("asc__n") - 1).alias(index))
    return number_by_range(values.select(column), [column], index)


def number_by_range(df: DataFrame, order: Sequence[str], index: str) -> DataFrame:
    """Number the rows in the given total order, starting at 0.

    Rows are range-partitioned, sorted inside each partition and numbered where they lie, in one
    exchange; the row counts of the partitions before are added. The numbered rows are pinned in the
    shared folder, so a lost executor cannot move the sampled borders between the two uses.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _number_partitions(ordered, index).select(*df.columns, index)


def _number_partitions(df: DataFrame, index: str) -> DataFrame:
    """Number the rows partition by partition, as they lie; pinned."""
    pinned = pin(df.withColumn("__id", F.monotonically_increasing_id()), "rows")
    pinned = pinned.withColumn("__part", F.shiftright("__id", PART_BITS)).withColumn(
        "__at", F.col("__id").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    )
    return _shift_by_part(pinned.drop("__id"), pinned, index)


def _shift_by_part(numbered: DataFrame, pinned: DataFrame, index: str) -> DataFrame:
    """Add the number of rows in earlier parts; one row per partition, hence broadcast."""
    counts = pinned.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    shifted = numbered.join(F.broadcast(offsets), "__part")
    return shifted.withColumn(index, (F.col("__at") + F.col("__offset")).cast("bigint")).drop("__part", "__at", "__offset")


def dense_id_map(df: DataFrame, column: str) -> DataFrame:
    """``(old_id, new_id)``: the distinct non-NULL values and their 0-based rank."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("old_id")).distinct()
    return number_distinct(values, "old_id", "new_id")


MOST_FILES_SENT = 20_000


def file_row_ids(parquet: DataFrame, name: str) -> DataFrame:
    """Number the rows of a parquet scan in file order, without sorting or moving them.

    Each row knows its position in its file; the rows of the files before it are added from a
    table with one entry per file. It is sent to the executors up to ``MOST_FILES_SENT`` files, which
    the driver counts in the scan's listing; beyond, the planner chooses the join.
    """
    columns = parquet.columns
    located = parquet.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = located.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    few = len(parquet.inputFiles()) <= MOST_FILES_SENT
    joined = located.join(F.broadcast(offsets) if few else offsets, "__file")
    return joined.select(*columns, (F.col("__at") + F.col("__offset")).alias(name))


def scan_row_ids(scan: DataFrame, name: str) -> DataFrame:
    """Number the rows of a text scan (CSV, JSON) in file order: by path, byte offset, then line.

    Large files are cut into splits that any task may read in any order. Each row knows its split's
    path and first byte from the scan's metadata, and its place among the rows that its task read one after
    the other; the rows of the splits before it are added from a table with one entry per split. The
    places are pinned in the shared folder, so ids stay fixed if a task is run again. Nothing is sorted or
    moved. The table of splits is sent to the executors up to ``MOST_FILES_SENT`` entries.

    ``scan`` must come straight from a file reader; filters and further columns go after this.
    """
    located = scan.select(
        *scan.columns,
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    pinned = pin(located, "rows")
    splits = pinned.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    ahead = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")
    offsets = pin(splits.select("__file", "__start", shift.alias("__shift")), "splits")
    few = offsets.limit(MOST_FILES_SENT + 1).count() <= MOST_FILES_SENT
    joined = pinned.join(F.broadcast(offsets) if few else offsets, ["__file", "__start"])
    return joined.select(*scan.columns, (F.col("__id") + F.col("__shift")).cast("bigint").alias(name))


def rekey_database(db: DatabaseSpec) -> tuple[DatabaseSpec, dict[str, DataFrame]]:
    """Replace every primary key by its dense rank and every foreign key by the parent's new id.

    Foreign keys without parent become NULL. Also returns the id map of each table; maps are
    written once, since the table and all its children read them.
    """
    maps = {name: pin(dense_id_map(table.df, table.primary_key), "ids") for name, table in db.tables.items()}
    tables = {}
    for name, table in db.tables.items():
        df = remap_foreign_key(table.df, table.primary_key, maps[name])
        for column, parent in table.foreign_keys.items():
            df = remap_foreign_key(df, column, maps[parent])
        tables[name] = TableSpec(
            name, df, table.primary_key, table.time_col, dict(table.foreign_keys), table.time_required
        )
    return DatabaseSpec(tables), maps
