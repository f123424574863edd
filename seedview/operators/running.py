"""Running sums, minima and maxima inside time-ordered groups, safe for very large groups.

The as-of join, the incident counts, the windowed child aggregates, dense numbering, exact
quantiles and AUROC are all the same shape: rows of a group, sorted by a position, where each
*probe* row asks for an aggregate of everything before (or after) it. In Spark that is one window
over ``UNBOUNDED PRECEDING .. CURRENT ROW``, linear in the number of rows, instead of a join that
emits every (probe, row) pair.

Many tasks share a small grid of seed times. Rows that no seed of the grid can tell apart are then
merged before they are shuffled (:func:`precombine`).

A window puts a whole group in one task. Large inputs are therefore probed first: one count per
group, over the key columns only. If no group is hot, the plain window is used. Hot groups are cut
at approximate quantiles of the position; each slice is its own window partition and the totals of
the slices before it are added afterwards. The tables of cuts and totals have at most ``fair``
groups times ``slices`` entries, which is why they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedview.session import SkewPolicy, pin

POS = "pos"
PROBE = "is_probe"
SLICE = "__slice"
CUTS = "__cuts"
COARSE = "__coarse"
STRIDE = 32
MAX_BRANCHES = 64

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def combine(how: str, left: Column, right: Column) -> Column:
    """Merge two partial aggregates; NULL is the neutral element."""
    if how == "sum":
        return F.coalesce(left + right, left, right)
    return F.least(left, right) if how == "min" else F.greatest(left, right)


def small_grid(probes: DataFrame, limit: int) -> list[int] | None:
    """The distinct probe positions in order if there are at most ``limit``, else None. Runs a job."""
    if limit <= 0:
        return None
    found = probes.select(POS).distinct().limit(limit + 1).collect()
    return sorted(row[0] for row in found) if len(found) <= limit else None


def interval_number(pos: Column, boundaries: Sequence[int]) -> Column:
    """How many of the sorted boundaries are at or below the position."""
    if len(boundaries) <= MAX_BRANCHES:
        return _search(pos, list(boundaries), 0)
    array = F.lit(list(boundaries)).cast("array<bigint>")
    coarse = F.size(F.filter(F.lit(list(boundaries[STRIDE - 1 :: STRIDE])).cast("array<bigint>"), lambda b: b <= pos))
    near = F.slice(array, coarse * STRIDE + 1, F.lit(STRIDE))
    return coarse * STRIDE + F.size(F.filter(near, lambda b: b <= pos))


def _search(pos: Column, boundaries: list[int], below: int) -> Column:
    """A balanced tree of comparisons, which compiles to a few branches per row."""
    if not boundaries:
        return F.lit(below)
    middle = len(boundaries) // 2
    return F.when(pos < boundaries[middle], _search(pos, boundaries[:middle], below)).otherwise(
        _search(pos, boundaries[middle + 1 :], below + middle + 1)
    )


def precombine(
    rows: DataFrame, by: Sequence[str], measures: dict[str, str], boundaries: Sequence[int]
) -> DataFrame:
    """Merge the rows of a group that lie between the same two boundaries, map-side first.

    If no probe starts or ends between two boundaries, any position inside can stand for all, so
    the merged row keeps the largest. A hot group shrinks to one row per interval and task.
    """
    return (
        rows.groupBy(*by, interval_number(F.col(POS), sorted(set(boundaries))).alias("__interval"))
        .agg(F.max(POS).alias(POS), *[MERGE[how](name).alias(name) for name, how in measures.items()])
        .drop("__interval")
    )


def hot_groups(rows: DataFrame, by: Sequence[str], skew: SkewPolicy) -> DataFrame | None:
    """Keys of the groups above the policy's limits, at most ``skew.fair`` rows; None if no group is.

    Runs a job: counts per group, combined map-side, decide the plan of everything after.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    fair_share = sizes.agg((F.sum("__rows") / F.lit(skew.fair)).alias("share")).scalar()
    limit = F.greatest(F.lit(float(skew.min_rows)), F.coalesce(fair_share, F.lit(0.0)))
    hot = pin(sizes.where(F.col("__rows") > limit).select(*by), "hot-groups")
    return None if hot.isEmpty() else hot


def _cut_points(events: DataFrame, by: Sequence[str], hot: DataFrame, skew: SkewPolicy) -> DataFrame:
    fractions = [i / skew.slices for i in range(1, skew.slices)]
    rows = events.join(F.broadcast(hot), list(by), "left_semi")
    cuts = rows.groupBy(*by).agg(F.percentile_approx(POS, fractions, 20 * skew.slices).alias(CUTS))
    return pin(cuts.withColumn(COARSE, F.filter(CUTS, lambda _, i: i % STRIDE == STRIDE - 1)), "cut-points")


def _slice_number() -> Column:
    """Number of cuts below the position: every 32nd cut first, then the 32 in between."""
    coarse = F.size(F.filter(COARSE, lambda cut: cut < F.col(POS)))
    near = F.slice(F.col(CUTS), coarse * STRIDE + 1, F.lit(STRIDE))
    fine = F.size(F.filter(near, lambda cut: cut < F.col(POS)))
    return F.when(F.col(CUTS).isNull(), F.lit(0)).otherwise(coarse * STRIDE + fine)


def running(
    events: DataFrame,
    by: Sequence[str],
    measures: dict[str, str],
    *,
    directions: Sequence[str] = ("asc",),
    tie: Sequence[str] = (),
    collapse: bool = True,
    skew: SkewPolicy | None = None,
) -> DataFrame:
    """Add ``{direction}__{measure}``, the aggregate over the rows up to and including each row.

    ``events`` needs the columns ``by``, ``pos`` (a number) and ``is_probe`` (probes carry NULL
    measures and come after other rows of the same position, in either direction). ``measures``
    maps columns to ``sum``, ``min`` or ``max``. ``tie`` orders rows of one position.

    With ``collapse`` the non-probe rows of a hot group are pre-aggregated per position before
    they are shuffled, so even a position shared by a third of the table is cheap; only their
    ``by``, ``pos`` and measures survive. Use ``collapse=False`` when those rows are numbered.
    """
    skew = skew or SkewPolicy.of(events)
    by = list(by)
    merged = [MERGE[how](name).alias(name) for name, how in measures.items()]
    rows, partition = events, by
    hot_keys = hot_groups(events, by, skew) if skew.active else None
    if hot_keys is not None:
        partition = by + [SLICE]
        events = pin(events, "events")
        cuts = _cut_points(events, by, hot_keys, skew)
        sliced = events.join(F.broadcast(cuts), by, "left").withColumn(SLICE, _slice_number())
        is_hot = F.col(CUTS).isNotNull()
        if collapse:
            collapsed = (
                sliced.where(is_hot & ~F.col(PROBE)).groupBy(*partition, POS).agg(*merged).withColumn(PROBE, F.lit(False))
            )
            hot = collapsed.unionByName(
                sliced.where(is_hot & F.col(PROBE)).drop(CUTS, COARSE), allowMissingColumns=True
            )
            rows = sliced.where(~is_hot).drop(CUTS, COARSE).unionByName(hot, allowMissingColumns=True)
        else:
            hot = sliced.where(is_hot)
            rows = sliced.drop(CUTS, COARSE)
        totals = hot.groupBy(*partition).agg(*merged)

    rows = skew.deal(rows, *partition)
    for direction in directions:
        position = F.col(POS).asc() if direction == "asc" else F.col(POS).desc()
        order = [position, F.col(PROBE).asc(), *[F.col(c).asc() if direction == "asc" else F.col(c).desc() for c in tie]]
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"{direction}__{m}": MERGE[how](m).over(window) for m, how in measures.items()})

    if hot_keys is not None:
        for direction in directions:
            step = F.col(SLICE).asc() if direction == "asc" else F.col(SLICE).desc()
            before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
            carry = totals.select(
                *partition, *[MERGE[how](m).over(before).alias(f"__carry_{m}") for m, how in measures.items()]
            )
            rows = rows.join(F.broadcast(carry), partition, "left")
            rows = rows.withColumns(
                {
                    f"{direction}__{m}": combine(how, F.col(f"{direction}__{m}"), F.col(f"__carry_{m}"))
                    for m, how in measures.items()
                }
            ).drop(*[f"__carry_{m}" for m in measures])
        rows = rows.drop(SLICE)
    return rows
