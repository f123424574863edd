"""Many-to-one equi joins: static lookups, parent lookups, key-to-date and id remaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedview.operators.running import hot_groups
from seedview.session import SkewPolicy, pin


def guard_unique(right: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``right``, whose rows raise an error that names the key if they share it with another row.

    The count is a window over the join's own key: a sort-merge join needs that partitioning and order
    anyway, so clean data pays for no pass, shuffle or sort beyond the join's, and a right side small
    enough to be broadcast is the only thing shuffled. Rows without key match nothing and may repeat.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    key = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    message = F.concat(F.lit(f"{what}: key "), key, F.lit(" occurs "), F.col("__n").cast("string"), F.lit(" times"))
    unique = F.assert_true(F.col("__n") == 1, message).isNull()
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return right.where(keyed).withColumn("__n", n).where(unique).drop("__n")


def lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, skew: SkewPolicy | None = None, guard: str | None = None
) -> DataFrame:
    """``left LEFT JOIN right`` where ``on`` is unique in ``right``.

    ``guard`` names a right side that comes from outside and is checked inside the join's own job
    (:func:`guard_unique`); right sides that were grouped by ``on`` need none.

    The planner picks broadcast or sort-merge from sizes. Large inputs are probed for hot keys; if
    there are any, their rows go through a join of their own: at most ``fair`` keys are hot and each
    has one right row, so that part of the right side is broadcast and the hot rows never move.
    Rows without key, which would all meet in one task, skip the join.
    """
    on = list(on)
    skew = skew or SkewPolicy.of(left)
    hot = hot_groups(left, on, skew) if skew.active else None
    checked = guard_unique(right, on, guard) if guard else right
    if hot is None:
        return left.join(checked, on, "left")
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    few = right.join(F.broadcast(hot), on, "left_semi")
    few = F.broadcast(guard_unique(few, on, guard) if guard else few)
    marked = pin(left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left"), "lookup")
    cold = marked.where(F.col("__hot").isNull() & keyed).drop("__hot").join(checked, on, "left")
    warm = marked.where(F.col("__hot")).drop("__hot").join(few, on, "left")
    keyless = marked.where(~keyed).drop("__hot")
    return cold.unionByName(warm).unionByName(keyless, allowMissingColumns=True)


def static_lookup(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, prefix: str = "", skew: SkewPolicy | None = None
) -> DataFrame:
    """All other columns of ``right`` for the matching key, renamed ``{prefix}{column}``; NULL if absent.

    A key that ``right`` holds twice is an error when the result is computed, as it would multiply rows.
    """
    renamed = right.select(
        F.col(right_key).alias("__key"), *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c != right_key]
    ).where(F.col("__key").isNotNull())
    joined = lookup(left.withColumn("__key", F.col(left_key)), renamed, ["__key"], skew=skew, guard=f"{prefix}{right_key}")
    return joined.drop("__key")


def remap_foreign_key(df: DataFrame, column: str, id_map: DataFrame) -> DataFrame:
    """Replace ``column`` by the new id of ``id_map(old_id, new_id)``; dangling keys become NULL."""
    columns = df.columns
    pairs = id_map.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    mapped = lookup(df, pairs, [column])
    return mapped.select(*[F.col("__new").alias(c) if c == column else F.col(c) for c in columns])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: must be empty for a lookup's right side."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
