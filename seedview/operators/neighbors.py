"""Sampled neighbourhoods: per instance one entity node and its most recent child rows.

Seeds travel down their key's rows in time order and carry the last ``k`` rows with them, so the child
table is read, shuffled and sorted once. If a key is hot, or ``k`` is large, rows are numbered instead and
each seed reads how many precede it, both from one sliced running count; its last ``k`` neighbours are the
rows numbered ``n-k+1 .. n``, fetched by an equi join on (key, number), which spreads even a single hot
entity over all tasks. All neighbours (``k=None``) are fetched the same way in blocks of rows: the rows up to
a seed are a prefix of its key's rows, so their numbers are the same for every seed. Undated tables give
each key's first ``k`` rows, reduced map-side. No pair outside the result is ever built.
"""

from __future__ import annotations

from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedview.functions.expressions import micros
from seedview.model import DatabaseSpec, TableSpec, TaskSpec, is_numeric
from seedview.operators.asof import asof_join
from seedview.operators.keys import number_by_range
from seedview.operators.lookup import lookup
from seedview.operators.running import POS, PROBE, hot_groups, running
from seedview.session import SkewPolicy, pin

Link = tuple[TableSpec, str, str]
"""(table, foreign key, node type)"""
MOST_CARRIED = 64
"""Largest number of neighbours that seeds carry with them."""
BLOCK = 1024
"""Rows of a key that meet the seeds together when all neighbours are asked for."""


def event_links(db: DatabaseSpec, entity_table: str) -> list[Link]:
    """One link per foreign key to the entity; the key joins the name if a table has several."""
    links = []
    for name, table in db.tables.items():
        keys = [c for c, parent in table.foreign_keys.items() if parent == entity_table]
        if name != entity_table:
            links += [(table, c, name if len(keys) == 1 else f"{name}_{c}") for c in keys]
    return links


def node_types(db: DatabaseSpec, task: TaskSpec) -> list[str]:
    return [task.entity_table] + [node for _, _, node in event_links(db, task.entity_table)]


def edge_types(db: DatabaseSpec, task: TaskSpec) -> list[tuple[str, str, str]]:
    """(source, relation, target) in both directions."""
    entity = task.entity_table
    out = []
    for _, _, node in event_links(db, entity):
        out += [(entity, f"has_{node}", node), (node, f"in_{entity}", entity)]
    return out


def numeric_features(df: DataFrame, prefix: str = "") -> Column:
    """All numeric and boolean columns as one float array, missing values as 0; ``[0]`` if none."""
    zero = F.lit(0.0).cast("float")
    columns = [
        F.coalesce(F.nanvl(F.col(f"{prefix}{f.name}").cast("float"), zero), zero)
        for f in df.schema.fields
        if is_numeric(f.dataType)
    ]
    return F.array(*(columns or [zero]))


def neighbor_nodes(
    db: DatabaseSpec, task: TaskSpec, k: Optional[int], rows: DataFrame | None = None, skew: SkewPolicy | None = None
) -> DataFrame:
    """Nodes ``(key, seed, node_type, node_idx, features)`` of every instance's neighbourhood.

    Exactly one entity node with index 0 (its row as of the seed if the entity table is dated;
    zeros if there is none) and at most ``k`` event nodes per link, oldest first, all with
    ``time <= seed``. Undated rows of a dated table are left out; a table without time column
    gives its first ``k`` rows by primary key. ``k=None`` takes all.
    """
    rows = task.task_table if rows is None else rows
    key, seed = task.key_columns
    seeds = rows.where(F.col(key).isNotNull() & F.col(seed).isNotNull()).select(key, seed).distinct()
    parts = [_entity_nodes(db.table(task.entity_table), task, seeds, skew)]
    for table, foreign_key, node in event_links(db, task.entity_table):
        features = table.df.where(F.col(foreign_key).isNotNull()).select(
            F.col(foreign_key).alias(key),
            F.col(table.primary_key).alias("__pk"),
            *([micros(table.time_col).alias(POS)] if table.time_col else []),
            numeric_features(table.df).alias("features"),
        )
        if table.time_col:
            policy = skew or SkewPolicy.of(rows, table.df)
            found = _dated_neighbors(seeds, features.where(F.col(POS).isNotNull()), key, seed, k, policy)
        else:
            found = _static_neighbors(seeds, features, key, seed, k, skew or SkewPolicy.of(rows, table.df))
        parts.append(found.withColumn("node_type", F.lit(node)))
    return reduce(lambda a, b: a.unionByName(b), parts).select(key, seed, "node_type", "node_idx", "features")


def _entity_nodes(entity: TableSpec, task: TaskSpec, seeds: DataFrame, skew) -> DataFrame:
    key, seed = task.key_columns
    features = numeric_features(entity.df)
    width = max(1, sum(is_numeric(f.dataType) for f in entity.df.schema.fields))
    known = entity.df.select(
        F.col(entity.primary_key).alias("__key"),
        *([F.col(entity.time_col).alias("__time")] if entity.time_col else []),
        features.alias("features"),
    )
    if entity.time_col:
        joined = asof_join(
            seeds, known, left_key=key, left_time=seed, right_key="__key", right_time="__time", skew=skew
        )
    else:
        joined = lookup(seeds, known.withColumnRenamed("__key", key), [key], skew=skew, guard=entity.name)
    placeholder = F.array_repeat(F.lit(0.0).cast("float"), width)
    return joined.select(
        key,
        seed,
        F.lit(entity.name).alias("node_type"),
        F.lit(0).alias("node_idx"),
        F.coalesce("features", placeholder).alias("features"),
    )


def _dated_neighbors(seeds, features, key, seed, k, skew) -> DataFrame:
    def events_of(rows: DataFrame) -> DataFrame:
        probes = seeds.withColumns({POS: micros(seed), PROBE: F.lit(True)})
        return rows.withColumn(PROBE, F.lit(False)).unionByName(probes, allowMissingColumns=True)

    events = events_of(features)
    hot = k is not None and skew.active and hot_groups(events, [key], skew) is not None
    if hot:
        # More than k rows of one key and instant: only the last k can be anybody's neighbours.
        same_instant = Window.partitionBy(key, POS).orderBy(F.col("__pk").desc())
        features = features.withColumn("__n", F.row_number().over(same_instant)).where(F.col("__n") <= k).drop("__n")
        events = events_of(features)
        hot = hot_groups(events, [key], skew) is not None
    if k is not None and k <= MOST_CARRIED and not hot:
        return _carried(skew.deal(events, key), key, seed, k)
    counted = events.withColumn("n", F.when(~F.col(PROBE), F.lit(1).cast("bigint")))
    numbered = pin(running(counted, [key], {"n": "sum"}, tie=["__pk"], collapse=False, skew=skew), "numbered")
    children = numbered.where(~F.col(PROBE)).select(key, F.col("asc__n").alias("__n"), "features")
    probes = numbered.where(F.col(PROBE) & (F.col("asc__n") > 0)).select(key, seed, F.col("asc__n").alias("__last"))
    return _all_before(probes, children, key, seed) if k is None else _last_before(probes, children, key, seed, k)


def _carried(events: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """One pass: the ``k`` last rows before each probe, oldest first, from one window."""
    carried = events.withColumn("__row", F.when(~F.col(PROBE), F.struct("features")))
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{POS}`, `{PROBE}`, `__pk`)"
    last = [F.expr(f"lag(__row, {n}) IGNORE NULLS {over}") for n in range(k, 0, -1)]
    found = carried.withColumn("__last", F.array(*last)).where(F.col(PROBE))
    found = found.select(key, seed, F.posexplode(F.filter("__last", lambda x: x.isNotNull())).alias("node_idx", "__row"))
    return found.select(key, seed, "node_idx", F.col("__row.features").alias("features"))


def _last_before(probes: DataFrame, children: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The ``k`` last of the rows numbered up to ``__last``."""
    first = F.greatest(F.col("__last") - k, F.lit(0).cast("bigint"))
    wanted = probes.select(key, seed, first.alias("__skipped"), F.explode(F.sequence(first + 1, F.col("__last"))).alias("__n"))
    return wanted.join(children, [key, "__n"]).select(
        key, seed, (F.col("__n") - F.col("__skipped") - 1).cast("int").alias("node_idx"), "features"
    )


def _all_before(probes: DataFrame, children: DataFrame, key: str, seed: str) -> DataFrame:
    """All rows numbered up to ``__last``: blocks of a key's rows meet the seeds that reach them."""
    block = lambda n: F.floor((n - 1) / BLOCK)
    reach = probes.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col("__last")))))
    pairs = reach.join(children.withColumn("__block", block(F.col("__n"))), [key, "__block"])
    return pairs.where(F.col("__n") <= F.col("__last")).select(key, seed, (F.col("__n") - 1).cast("int").alias("node_idx"), "features")


def _static_neighbors(seeds: DataFrame, features: DataFrame, key: str, seed: str, k: Optional[int], skew: SkewPolicy) -> DataFrame:
    """Each key's first ``k`` rows by primary key, for every seed of it.

    A row number that is only compared with ``k`` is limited before the shuffle: a map task sends at
    most ``k`` rows of a key. On large inputs a key's rows are first reduced in ``skew.slices`` parts, so what
    meets in one task is at most ``k`` rows a part, whatever the number of map tasks. All rows (``k=None``)
    are numbered in one range-partitioned order of (key, primary key) and fetched in blocks.
    """
    if k is None:
        ranked = pin(number_by_range(features, [key, "__pk"], "__i"), "ranked")
        sizes = pin(ranked.groupBy(key).agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__last")), "sizes")
        placed = lookup(ranked, sizes.drop("__last"), [key], skew=skew)
        children = placed.select(key, (F.col("__i") - F.col("__first") + 1).alias("__n"), "features")
        probes = lookup(seeds, sizes.drop("__first"), [key], skew=skew).where("__last IS NOT NULL")
        return _all_before(probes, children, key, seed)
    if skew.active:
        features = _first(features.withColumn("__slice", F.pmod(F.xxhash64("__pk"), F.lit(skew.slices))), [key, "__slice"], k)
    ranked = _first(features, [key], k).withColumn("node_idx", (F.col("__n") - 1).cast("int"))
    lists = ranked.groupBy(key).agg(F.collect_list(F.struct("node_idx", "features")).alias("__nodes"))
    found = lookup(seeds, lists, [key], skew=skew).select(key, seed, F.explode("__nodes").alias("__node"))
    return found.select(key, seed, "__node.node_idx", "__node.features")


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("__pk")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)


def neighbor_edges(nodes: DataFrame, task: TaskSpec) -> DataFrame:
    """Edges between the entity node and each event node, in both directions."""
    entity = task.entity_table
    events = nodes.where(F.col("node_type") != entity)
    event, root = F.col("node_type"), F.lit(entity)

    def edge(src, src_idx, relation, dst, dst_idx):
        return F.struct(
            src.alias("src_type"),
            src_idx.cast("int").alias("src_idx"),
            relation.alias("relation"),
            dst.alias("dst_type"),
            dst_idx.cast("int").alias("dst_idx"),
        )

    both = F.array(
        edge(root, F.lit(0), F.concat(F.lit("has_"), event), event, F.col("node_idx")),
        edge(event, F.col("node_idx"), F.lit(f"in_{entity}"), root, F.lit(0)),
    )
    return events.select(*task.key_columns, F.explode(both).alias("e")).select(*task.key_columns, "e.*")
