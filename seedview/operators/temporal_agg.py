"""Windowed aggregates of child tables as of each seed time, for one or many lookback windows.

A seed at ``s`` with a lookback of ``W`` days aggregates the child rows with
``s - W <= time <= s``. Time is cut into blocks of length ``W``; the window then always spans the
end of one block and the start of the next, so it is the merge of two running aggregates: rows of
the seed's own block up to ``s``, and rows of the block before from ``s - W`` on. Both are linear,
need no subtraction (sums lose no digits, minima work too) and never pair seeds with rows. Without
a lookback there is one block. All windows of a sweep share one scan and one shuffle.

Distinct counts use the same events: a value is live for a seed if it was seen in the window, so
each value adds +1 where it becomes live and -1 where it stops, and a seed reads the running sum.
First and last occurrence per (key, block, value) come from one map-side-combined aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.functions.expressions import MICROS_PER_DAY, category, micros
from seedview.model import AGGREGATIONS, TableSpec, split_roles
from seedview.operators.lookup import lookup
from seedview.operators.running import MERGE, POS, PROBE, combine, precombine, running, small_grid
from seedview.session import SkewPolicy, pin

Lookbacks = Sequence[Optional[int]]
MAX_BLOCKS_TO_BROADCAST = 100_000


def temporal_aggregates(
    instances: DataFrame,
    table: TableSpec,
    *,
    entity_key: str,
    seed_time_col: str,
    foreign_key: str,
    lookbacks: Lookbacks = (None,),
    functions: Sequence[str] = AGGREGATIONS,
    recency: bool = True,
    null_time: str = "keep",
    columns: Sequence[str] | None = None,
    seed_range=None,
    skew: SkewPolicy | None = None,
) -> DataFrame:
    """One row per distinct (entity, seed, lookback) with the aggregates of ``table``.

    Columns: the two keys, ``lookback_days`` (NULL for no limit), ``{table}__row_count``,
    ``{table}__recency_days`` and ``{table}__{column}__{mean,sum,min,max,nunique}``. Counts are 0
    and everything else NULL without history. ``null_time="keep"`` counts undated rows in every
    window, ``"drop"`` ignores them; a table without time column counts all rows for every seed.
    ``columns`` restricts the aggregated columns. Instances without key or seed get no row. Any
    ``seed_range`` but None lets the bounds of the seeds be measured and pushed into the child's scan.
    """
    if null_time not in ("keep", "drop"):
        raise ValueError("null_time must be 'keep' or 'drop'")
    numeric, categorical = split_roles(table.df, [entity_key, foreign_key, seed_time_col], table.time_col)
    if columns is not None:
        numeric = [c for c in numeric if c in columns]
        categorical = [c for c in categorical if c in columns]
    if "nunique" not in functions:
        categorical = []
    if not {"mean", "sum", "min", "max"} & set(functions):
        numeric = []
    plan = _Layout(table, entity_key, foreign_key, numeric, categorical, tuple(functions))
    skew = skew or SkewPolicy.of(instances, table.df)

    seeds = (
        instances.where(F.col(entity_key).isNotNull() & F.col(seed_time_col).isNotNull())
        .select(entity_key, seed_time_col)
        .distinct()
    )
    # Each seed is repeated per window. In the keys' own order the planner would drop this as done by distinct.
    seeds = skew.deal(seeds, seed_time_col, entity_key)
    keyed = table.df.where(F.col(foreign_key).isNotNull())
    dated = undated = None
    grid = None
    if table.time_col and skew.active:
        grid = small_grid(seeds.select(micros(seed_time_col).alias(POS)), skew.grid)
        if grid:
            seed_range = tuple(datetime(1970, 1, 1) + timedelta(microseconds=m) for m in (grid[0], grid[-1]))
    if table.time_col and seed_range is not None and not grid:
        # Without a window that ends, bounds spare a small input nothing that is worth a job.
        worth = skew.active or any(w is not None for w in lookbacks)
        seed_range = _measured_range(instances, seed_time_col) if worth else None
    if table.time_col:
        dated = _bounded(keyed.where(F.col(table.time_col).isNotNull()), table.time_col, lookbacks, seed_range)
        if null_time == "keep" and not table.time_required:
            undated = keyed.where(F.col(table.time_col).isNull())
    else:
        undated = keyed

    if dated is not None:
        result = _dated_part(seeds, dated, undated, plan, seed_time_col, lookbacks, seed_range, grid, skew)
    else:
        windows = F.array(*[F.lit(i) for i in range(len(lookbacks))])
        result = seeds.withColumn("window_id", F.explode(windows))
    if undated is not None:
        result = lookup(result, _undated_part(undated, plan), [entity_key], skew=skew)
    return result.select(
        entity_key,
        seed_time_col,
        _lookback_of(lookbacks).alias("lookback_days"),
        *plan.features(seed_time_col, dated is not None, undated is not None, recency),
    )


class _Layout:
    """Names of the partial aggregates and how they become features."""

    def __init__(self, table, entity_key, foreign_key, numeric, categorical, functions):
        self.table, self.entity_key, self.foreign_key = table, entity_key, foreign_key
        self.numeric, self.categorical, self.functions = numeric, categorical, functions
        self.measures: dict[str, str] = {}
        if "count" in functions:
            self.measures["n"] = "sum"
        if table.time_col:
            self.measures["last"] = "max"
        for i, _ in enumerate(numeric):
            if "mean" in functions:
                self.measures[f"c{i}_cnt"] = "sum"
            if {"mean", "sum"} & set(functions):
                self.measures[f"c{i}_sum"] = "sum"
            for how in ("min", "max"):
                if how in functions:
                    self.measures[f"c{i}_{how}"] = how
        self.distincts = [f"u{i}" for i, _ in enumerate(categorical)]

    def row_values(self, pos: Column | None) -> list[Column]:
        """Each measure for a single child row."""
        values: dict[str, Column] = {"n": F.lit(1).cast("bigint")}
        values["last"] = pos if pos is not None else F.lit(None).cast("bigint")
        for i, name in enumerate(self.numeric):
            x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
            values |= {f"c{i}_cnt": x.isNotNull().cast("bigint"), f"c{i}_sum": x, f"c{i}_min": x, f"c{i}_max": x}
        return [values[m].alias(m) for m in self.measures]

    def categories(self) -> Column:
        """(column number, value) pairs of one child row."""
        types = dict(self.table.df.dtypes)
        return F.array(
            *[
                F.struct(F.lit(i).alias("u"), category(c, types[c]).alias("value"))
                for i, c in enumerate(self.categorical)
            ]
        )

    def features(self, seed_time_col: str, dated: bool, undated: bool, recency: bool) -> list[Column]:
        def value(measure: str, how: str) -> Column:
            sides = ([F.col(f"d_{measure}")] if dated else []) + ([F.col(f"s_{measure}")] if undated else [])
            return sides[0] if len(sides) == 1 else combine(how, *sides)

        name = self.table.name
        out = []
        if "count" in self.functions:
            out.append(F.coalesce(value("n", "sum"), F.lit(0)).cast("bigint").alias(f"{name}__row_count"))
        if self.table.time_col and recency:
            days = (micros(seed_time_col) - F.col("d_last")) / F.lit(float(MICROS_PER_DAY))
            out.append(days.alias(f"{name}__recency_days"))
        for i, column in enumerate(self.numeric):
            feature = f"{name}__{column}__"
            if "mean" in self.functions:
                count = value(f"c{i}_cnt", "sum")
                mean = F.when(count > 0, value(f"c{i}_sum", "sum") / count)
                out.append(mean.alias(feature + "mean"))
            for how in ("sum", "min", "max"):
                if how in self.functions:
                    out.append(value(f"c{i}_{how}", how).alias(feature + how))
        for u, column in zip(self.distincts, self.categorical):
            out.append(F.coalesce(value(u, "sum"), F.lit(0)).cast("bigint").alias(f"{name}__{column}__nunique"))
        return out


def _lookback_of(lookbacks: Lookbacks) -> Column:
    days = F.lit(None).cast("bigint")
    for i, lookback in enumerate(lookbacks):
        if lookback is not None:
            days = F.when(F.col("window_id") == i, F.lit(lookback).cast("bigint")).otherwise(days)
    return days


def _measured_range(instances: DataFrame, seed_time_col: str):
    """First and last seed time, or None without seeds."""
    time = F.col(seed_time_col).cast("timestamp_ntz")
    first, last = instances.agg(F.min(time), F.max(time)).first()
    return None if first is None else (first, last)


def _bounded(child: DataFrame, time_col: str, lookbacks: Lookbacks, seed_range) -> DataFrame:
    """Literal time bounds, which reach the scan: nothing after the last seed can matter, nor
    anything before the first seed's longest window."""
    if seed_range is None:
        return child
    first, last = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in seed_range)
    child = child.where(F.col(time_col) <= last)
    if all(w is not None for w in lookbacks):
        child = child.where(F.col(time_col) >= F.timestamp_add("DAY", F.lit(-max(lookbacks)), first))
    return child


def _width(lookback: int) -> int:
    return max(lookback * MICROS_PER_DAY, 1)


def _block(pos: Column, lookback: Optional[int]) -> Column:
    """Number of the block a position falls in; a window without limit is one block."""
    if lookback is None:
        return F.lit(0).cast("bigint")
    width = F.lit(_width(lookback))
    return F.call_function("div", pos - F.pmod(pos, width), width)


def _blocks(pos: Column, lookbacks: Lookbacks) -> Column:
    """One (window, block) pair per window."""
    return F.array(
        *[F.struct(F.lit(i).alias("window_id"), _block(pos, w).alias("block")) for i, w in enumerate(lookbacks)]
    )


def _probe_points(pos: Column, lookbacks: Lookbacks) -> Column:
    """Where a seed asks: at its own position and, for limited windows, one width earlier."""
    points = []
    for i, lookback in enumerate(lookbacks):
        block = _block(pos, lookback)
        point = lambda block, at, own: F.struct(
            F.lit(i).alias("window_id"), block.alias("block"), at.alias(POS), F.lit(own).alias("own_block")
        )
        points.append(point(block, pos, True))
        if lookback:
            points.append(point(block - 1, pos - F.lit(_width(lookback)), False))
    return F.array(*points)


def _value_spans(pos: Column, lookbacks: Lookbacks) -> Column:
    """Where an occurrence of a value matters: in its own block and, for limited windows, the next."""
    none = F.lit(None).cast("bigint")
    spans = []
    for i, lookback in enumerate(lookbacks):
        block = _block(pos, lookback)
        span = lambda block, first, prev: F.struct(
            F.lit(i).alias("window_id"), block.alias("block"), first.alias("first"), prev.alias("prev")
        )
        spans.append(span(block, pos, none))
        if lookback:
            spans.append(span(block + 1, none, pos))
    return F.array(*spans)


def _width_of(lookbacks: Lookbacks) -> Column:
    width = F.lit(None).cast("bigint")
    for i, lookback in enumerate(lookbacks):
        if lookback is not None:
            width = F.when(F.col("window_id") == i, F.lit(_width(lookback))).otherwise(width)
    return width


def _dated_part(seeds, dated, undated, plan, seed_time_col, lookbacks, seed_range, grid, skew) -> DataFrame:
    """Partial aggregates ``d_*`` of every (seed, window); each is there, since each is probed."""
    group = [plan.entity_key, "window_id", "block"]
    pos = micros(plan.table.time_col)
    seed_pos = micros(seed_time_col)
    limited = any(lookbacks)
    probes = seeds.select(plan.entity_key, seed_time_col, F.explode(_probe_points(seed_pos, lookbacks)).alias("w"))
    probes = probes.select(plan.entity_key, seed_time_col, "w.*")

    rows = dated.select(
        F.col(plan.foreign_key).alias(plan.entity_key), pos.alias(POS), *plan.row_values(pos), *_category_column(plan)
    )
    needed = _needed_blocks(seeds, seed_time_col, lookbacks, seed_range)
    values = None
    if plan.categorical:
        values = rows.select(plan.entity_key, POS, F.explode("categories").alias("c"))
        values = values.select(plan.entity_key, POS, "c.u", "c.value").where(F.col("value").isNotNull())
    rows = rows.drop("categories")
    cuts: list[int] = []
    if grid:
        cuts = [s + 1 for s in grid] + [s - w * MICROS_PER_DAY for s in grid for w in lookbacks if w is not None]
        rows = pin(precombine(rows, [plan.entity_key], plan.measures, cuts), "child")
        values = values and pin(precombine(values, [plan.entity_key, "u", "value"], {}, cuts), "values")
    skew = _unprobed(skew, seeds, rows, values, plan, grid, len(cuts) + 1)
    contributions = rows.withColumn("w", F.explode(_blocks(F.col(POS), lookbacks)))
    contributions = contributions.select(plan.entity_key, POS, "w.window_id", "w.block", *plan.measures)
    if needed is not None:
        contributions = contributions.join(F.broadcast(needed), ["window_id", "block"], "left_semi")

    events = contributions.withColumn(PROBE, F.lit(False)).unionByName(
        probes.withColumn(PROBE, F.lit(True)), allowMissingColumns=True
    )
    measures = dict(plan.measures)
    if plan.categorical:
        own_needed = needed.where("own_block") if needed is not None else None
        changes = _distinct_changes(values, undated, plan, lookbacks, own_needed)
        events = events.unionByName(changes.withColumn(PROBE, F.lit(False)), allowMissingColumns=True)
        measures |= {u: "sum" for u in plan.distincts}

    answers = running(
        events, group, measures, directions=("asc", "desc") if limited else ("asc",), skew=skew
    ).where(F.col(PROBE))
    picked = [
        (F.when(F.col("own_block"), F.col(f"asc__{m}")).otherwise(F.col(f"desc__{m}")) if limited else F.col(f"asc__{m}")).alias(m)
        for m in plan.measures
    ]
    picked += [F.when(F.col("own_block"), F.col(f"asc__{u}")).alias(u) for u in plan.distincts]
    halves = answers.select(plan.entity_key, seed_time_col, "window_id", *picked)
    keys = [plan.entity_key, seed_time_col, "window_id"]
    if not limited:
        return halves.select(*keys, *[F.col(m).alias(f"d_{m}") for m in measures])
    # A seed's halves come from different groups, so merging them before the shuffle would spare nothing.
    halves = skew.deal(halves, plan.entity_key, seed_time_col)
    return halves.groupBy(*keys).agg(*[MERGE[how](m).alias(f"d_{m}") for m, how in measures.items()])


def _unprobed(skew: SkewPolicy, seeds, rows, values, plan: _Layout, grid, n_intervals: int) -> SkewPolicy:
    """The policy without its probe of all events, if the rows of each key are too few for a hot group.

    In a group a row is one event, a value two at most (it becomes live and stops), and a seed two. The events
    themselves are costly to count: distinct values meet in two shuffles before they are events.
    """
    if not skew.active:
        return skew
    key = plan.entity_key
    weighed = lambda df, n: df.select(key, F.lit(n).alias("__events"))
    if grid:  # merged rows: one for each interval of a key at most
        known = n_intervals + 2 * len(grid)
        parts = [] if values is None else [weighed(values, 2)]
    else:
        known, parts = 0, [weighed(rows, 1 + 2 * len(plan.categorical)), weighed(seeds, 2)]
    if parts:
        sizes = reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(F.sum("__events").alias("__events"))
        known += sizes.agg(F.max("__events")).first()[0] or 0
    return replace(skew, active=False) if known <= skew.min_rows else skew


def _category_column(plan: _Layout) -> list[Column]:
    return [plan.categories().alias("categories")] if plan.categorical else []


def _needed_blocks(seeds, seed_time_col, lookbacks: Lookbacks, seed_range) -> Optional[DataFrame]:
    """The (window, block) pairs some seed asks for, if the seed range proves there are few.

    Rows of other blocks are dropped before they are shuffled.
    """
    if seed_range is None or not any(lookbacks):
        return None
    span = (seed_range[1] - seed_range[0]).days + 1
    bound = sum(1 if lookback is None else span // max(lookback, 1) + 3 for lookback in lookbacks)
    if bound > MAX_BLOCKS_TO_BROADCAST:
        return None
    times = seeds.select(micros(seed_time_col).alias(POS)).distinct()
    points = times.select(F.explode(_probe_points(F.col(POS), lookbacks)).alias("w")).select("w.*")
    return points.groupBy("window_id", "block").agg(F.max("own_block").alias("own_block"))


def _distinct_changes(values, undated, plan, lookbacks, needed) -> DataFrame:
    """Where the number of live values of each categorical column changes, per group and position."""
    key = plan.entity_key
    if undated is not None:
        always = undated.select(
            F.col(plan.foreign_key).alias(key), F.explode(plan.categories()).alias("c")
        ).select(key, "c.u", "c.value")
        values = values.join(always.distinct(), [key, "u", "value"], "left_anti")

    seen = values.select(key, "u", "value", F.explode(_value_spans(F.col(POS), lookbacks)).alias("w"))
    seen = seen.select(key, "u", "value", "w.*")
    if needed is not None:
        seen = seen.join(F.broadcast(needed), ["window_id", "block"], "left_semi")
    spans = seen.groupBy(key, "window_id", "block", "u", "value").agg(
        F.min("first").alias("first"), F.max("prev").alias("prev")
    )
    width = _width_of(lookbacks)
    start, expiry = F.col("block") * width, F.col("prev") + width
    has_prev = F.col("prev").isNotNull()
    renewed = F.col("first").isNotNull() & (F.col("first") <= expiry)
    next_start = (F.col("block") + 1) * width
    change = lambda at, delta: F.struct(at.alias(POS), F.lit(delta).cast("bigint").alias("delta"))
    changes = F.filter(
        F.array(
            F.when(has_prev, change(start, 1)),
            F.when(has_prev & ~renewed & (expiry + 1 < next_start), change(expiry + 1, -1)),
            F.when(F.col("first").isNotNull() & (~has_prev | ~renewed), change(F.col("first"), 1)),
        ),
        lambda c: c.isNotNull(),
    )
    steps = spans.select(key, "window_id", "block", "u", F.explode(changes).alias("c"))
    return steps.groupBy(key, "window_id", "block", F.col(f"c.{POS}").alias(POS)).agg(
        *[
            F.sum(F.when(F.col("u") == i, F.col("c.delta"))).alias(u)
            for i, u in enumerate(plan.distincts)
        ]
    )


def _undated_part(undated: DataFrame, plan: _Layout) -> DataFrame:
    """Aggregates per key that hold for every seed."""
    key = plan.entity_key
    rows = undated.select(F.col(plan.foreign_key).alias(key), *plan.row_values(None), *_category_column(plan))
    total = rows.groupBy(key).agg(
        *[MERGE[how](m).alias(f"s_{m}") for m, how in plan.measures.items()], F.count(F.lit(1)).alias("s_rows")
    )
    if plan.categorical:
        values = rows.select(key, F.explode("categories").alias("c")).select(key, "c.u", "c.value")
        distinct = values.where(F.col("value").isNotNull()).distinct()
        counts = distinct.groupBy(key).agg(
            *[F.count(F.when(F.col("u") == i, 1)).alias(f"s_{u}") for i, u in enumerate(plan.distincts)]
        )
        total = total.join(counts, key, "left")
    return total
