"""Session settings, shared scratch folder and input-size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seedview", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the views rely on; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only for local masters.

    Executors may be lost at any time, so a cluster without a shared folder is an error
    rather than a silent fall-back to one machine's disk. The local folder goes when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="seedview-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and go on from the files.

    Cuts the lineage where several branches need the same rows, survives lost executors, and,
    unlike a row checkpoint, keeps column pruning and known sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leaf_bytes(*frames: DataFrame) -> int:
    """Bytes of all base relations below the frames, from the planner's statistics.

    File relations report their size on disk. Relations of unknown size report the
    planner's default (practically infinite), so "unknown" is treated as "large".
    """
    total = 0
    for frame in frames:
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        total += sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.length()))
    return int(total)


def _bytes_conf(spark: SparkSession, key: str) -> int:
    text = spark.conf.get(key).strip().lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    text = text.removesuffix("b")
    return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(text)


PART_BYTES = 4 << 20
"""Bytes of input files for which large inputs get a partition."""
UNKNOWN_BYTES = 1 << 50
"""Sizes from here on are the planner's default for relations it knows nothing about."""


@dataclass(frozen=True)
class SkewPolicy:
    """When and how groups that hold too many rows are split.

    ``active``    plan the split at all.
    ``min_rows``  groups up to this size are never split.
    ``fair``      a group is hot if it also holds more than ``1/fair`` of all rows, so there
                  are at most ``fair`` hot groups and the tables that describe them are small.
    ``slices``    pieces per hot group.
    ``grid``      seeds that share at most this many instants are treated as a grid, see
                  :func:`seedview.operators.running.precombine`.
    ``parts``     partitions of what is sorted or repeated inside one task, in proportion to the
                  input; 0 leaves their number to the planner.
    """

    active: bool
    min_rows: int
    fair: int
    slices: int
    grid: int = 256
    parts: int = 0

    @staticmethod
    def of(*frames: DataFrame) -> "SkewPolicy":
        """Active unless all inputs together fit in one input split: then no group can be larger."""
        spark = frames[0].sparkSession
        mode = spark.conf.get("seedview.skew", "auto")
        planned = int(spark.conf.get("spark.sql.shuffle.partitions"))
        size = 0
        if mode == "auto":
            size = leaf_bytes(*frames)
            active = size > _bytes_conf(spark, "spark.sql.files.maxPartitionBytes")
        else:
            active = mode == "always"
        known = size < UNKNOWN_BYTES
        fair = int(spark.conf.get("seedview.skew.fair", str(planned)))
        return SkewPolicy(
            active=active,
            min_rows=int(spark.conf.get("seedview.skew.minRows", "1000000")),
            fair=fair,
            slices=int(spark.conf.get("seedview.skew.slices", str(min(max(fair, 64), 1000)))),
            grid=int(spark.conf.get("seedview.skew.grid", "256")),
            parts=max(planned, size // PART_BYTES if known else 0) if active else 0,
        )

    def deal(self, df: DataFrame, *keys: str) -> DataFrame:
        """Deal a large frame out by its keys into ``parts`` partitions, which stay as they are.

        Adaptive execution joins partitions up to a size as sent; rows that are then sorted with their
        running aggregates, or repeated per window, take many times that in one task.
        """
        return df.repartition(self.parts, *keys) if self.parts else df
