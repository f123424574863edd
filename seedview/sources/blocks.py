"""Row-aligned feature blocks with an index of splits, as one wide table per split part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedview.operators.keys import file_row_ids
from seedview.operators.splits import indexed_split
from seedview.sources.csvdb import missing_files
from seedview.sources.tables import SPLITS

BLOCK_ORDER = ("num", "bin", "cat", "meta")
REQUIRED_BLOCKS = ("num", "bin", "cat")


def read_blocks(spark: SparkSession, root: str, include_meta: bool = False, row_id: str = "row_id") -> dict[str, DataFrame]:
    """The parquet blocks ``X_{num,bin,cat[,meta]}`` below ``root``, keyed by ``row_id``.

    Blocks without that column are aligned by position: row n of each is about the same thing. They are
    numbered in file order, which each row knows from its file's footer, so nothing is sorted; blocks may be
    cut into files differently, but must have equally many rows, which the footers tell. ``meta`` is
    optional even if asked for; the other blocks are not.
    """
    wanted = [*REQUIRED_BLOCKS, *(["meta"] if include_meta else [])]
    absent = missing_files(spark, root, [f"X_{name}.parquet" for name in wanted])
    found = [name for name in wanted if f"X_{name}.parquet" not in absent]
    check_blocks({name: None for name in found})
    scans = {name: spark.read.parquet(f"{root}/X_{name}.parquet") for name in found}
    placed = {name: scan for name, scan in scans.items() if row_id not in scan.columns}
    rows = {name: scan.count() for name, scan in placed.items()}
    if len(set(rows.values())) > 1:
        raise ValueError(f"blocks differ in their number of rows: {rows}")
    return {name: file_row_ids(scan, row_id) if name in placed else scan for name, scan in scans.items()}


def write_block(block: DataFrame, order: Sequence[str], path: str, files: int) -> None:
    """Write a block whose rows are known by position: in the given order, over ``files`` files, without it."""
    block.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*order).write.parquet(path)


def read_split_index(spark: SparkSession, root: str) -> DataFrame:
    """``(split_name, split, row_id)`` of all ``split-{name}/{part}_idx.parquet`` files below ``root``.

    One scan over all files; names come from their paths. A split without one of its parts is an error.
    """
    path = F.col("_metadata.file_path")
    index = spark.read.parquet(f"{root}/split-*/*_idx.parquet").select(
        F.regexp_extract(path, r"/split-([^/]+)/[^/]+_idx\.parquet", 1).alias("split_name"),
        F.regexp_extract(path, r"/([^/]+)_idx\.parquet", 1).alias("split"),
        "row_id",
    )
    for folder in available_folders(spark, root):
        absent = missing_files(spark, f"{root}/split-{folder}", [f"{part}_idx.parquet" for part in SPLITS])
        if absent:
            raise FileNotFoundError(f"split {folder!r} lacks {', '.join(absent)}")
    return index


def available_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the ``split-{name}`` folders below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path(root, "split-*"))
    return sorted(f.getPath().getName().removeprefix("split-") for f in found or [] if f.isDirectory())


def block_features(blocks: Mapping[str, DataFrame], row_id: str = "row_id") -> list[str]:
    """Feature columns in block order."""
    return [c for name in BLOCK_ORDER if name in blocks for c in blocks[name].columns if c != row_id]


def assemble_blocks(
    blocks: Mapping[str, DataFrame], labels: DataFrame, index: DataFrame, split_name: str, row_id: str = "row_id"
) -> DataFrame:
    """``row_id``, ``split``, the label and all block columns as float, for one named split.

    ``index`` has ``(split_name, split, row_id)``. The label table and blocks meet on ``row_id``. Blocks
    of few values take next to nothing on disk, whatever their rows, so file sizes must not have them
    broadcast: every join is a merge.
    """
    chosen = index.where(F.col("split_name") == split_name)
    wide = indexed_split(labels, chosen, row_id)
    for name in BLOCK_ORDER:
        if name in blocks:
            block = blocks[name]
            floats = [F.col(c).cast("float").alias(c) for c in block.columns if c != row_id]
            wide = wide.join(block.select(row_id, *floats).hint("merge"), row_id)
    return wide


def available_splits(index: DataFrame) -> DataFrame:
    return index.select("split_name").distinct()


def check_blocks(blocks: Mapping[str, DataFrame], required: Sequence[str] = REQUIRED_BLOCKS) -> None:
    missing = [name for name in required if name not in blocks]
    if missing:
        raise FileNotFoundError(f"missing feature block(s): {missing}")
