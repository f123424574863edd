"""The registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame.

Doubles are rounded at the very end, because sums of doubles depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.functions import invariance, scores
from seedview.functions.expressions import add_days, sigmoid
from seedview.model import DatabaseSpec, TableSpec, TaskSpec, ViewConfig
from seedview.operators import audit, dates, degrees, keys, lookup, neighbors, prep, sample, splits, views
from seedview.operators.asof import asof_join
from seedview.operators.temporal_agg import temporal_aggregates
from seedview.plans import models, protocol
from seedview.session import scratch_path
from seedview.sources import blocks, csvdb, problems, sinks, sweeps, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VAL_CUTOFF, TEST_CUTOFF = datetime(1999, 1, 1), datetime(2000, 1, 1)
SWEEP = (7, 30, 90, None)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles}) if doubles else df


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def with_fixed_split(task: TaskSpec) -> TaskSpec:
    cut = [problems.timestamp(t) for t in (VAL_CUTOFF, TEST_CUTOFF)]
    return task.with_table(splits.assign_split(task.task_table, task.seed_time_col, *cut))


def aggregates(db: DatabaseSpec, task: TaskSpec, table: str, foreign_key: str, **options) -> DataFrame:
    return temporal_aggregates(
        task.task_table,
        db.table(table),
        entity_key=task.entity_key,
        seed_time_col=task.seed_time_col,
        foreign_key=foreign_key,
        **{"seed_range": task.seed_range, **options},
    )


# Joins


@query
def asof_last_order(spark, root):
    db, task = problems.customer_reorder(spark, root)
    out = asof_join(
        task.task_table.select(*task.key_columns),
        db.table("orders").df,
        left_key="c_custkey",
        left_time="seed_time",
        right_key="o_custkey",
        right_time="o_orderdate",
        tie="o_orderkey",
        prefix="last__",
        keep_time=True,
    )
    return rounded(out)


@query
def asof_tie_break(spark, root):
    """Events known by the day only: many rows share a time, the largest event id wins."""
    _, task = problems.user_purchase(spark, root)
    daily = read(spark, root, "events").select(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id", "event_type"
    )
    return asof_join(
        task.task_table.select(*task.key_columns),
        daily,
        left_key="c_custkey",
        left_time="seed_time",
        right_key="user_id",
        right_time="day",
        tie="event_id",
        prefix="last__",
    )


@query
def static_lookup_nation(spark, root):
    customers = read(spark, root, "customer").select("c_custkey", "c_nationkey")
    return lookup.static_lookup(customers, "c_nationkey", read(spark, root, "nation"), "n_nationkey", "nation__")


@query
def duplicate_line_keys(spark, root):
    """(order, line number) is no key of lineitem: the check every lookup's right side must pass."""
    lines = read(spark, root, "lineitem").withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return lookup.duplicate_keys(lines, "line_key")


@query
def parent_lookup_2hop(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(views.build_view(db, task, ViewConfig("jt_entity", max_path_hops=2)))


@query
def seed_child_range_counts(spark, root):
    """Rows in [seed - 180 days, seed] per instance, without building the (seed, row) pairs."""
    db, task = problems.customer_reorder(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey", lookbacks=[180], functions=["count"]))


# Temporal aggregates


@query
def tagg_orders_w30(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey", lookbacks=[30]))


@query
def tagg_orders_all(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey"))


@query
def tagg_orders_selected(spark, root):
    """A subset of the functions, no recency."""
    db, task = problems.customer_reorder(spark, root)
    return rounded(
        aggregates(db, task, "orders", "o_custkey", lookbacks=[90], functions=["count", "max"], recency=False)
    )


@query
def tagg_events_w7(spark, root):
    db, task = problems.user_purchase(spark, root)
    return rounded(aggregates(db, task, "events", "user_id", lookbacks=[7]))


@query
def tagg_lines_by_order(spark, root):
    db, task = problems.order_lines(spark, root)
    return rounded(aggregates(db, task, "lineitem", "l_orderkey"))


@query
def tagg_moved_task(spark, root):
    """Seeds moved 500 days back after the task was made: bounds must follow the seeds that are there."""
    db, task = problems.customer_reorder(spark, root)
    moved = task.task_table.withColumn("seed_time", F.timestamp_add("DAY", F.lit(-500), F.col("seed_time")))
    return rounded(aggregates(db, task.with_table(moved), "orders", "o_custkey", lookbacks=[30, None]))


def _partly_dated(spark, root) -> tuple[DatabaseSpec, TaskSpec]:
    """Orders of status F lose their date."""
    db, task = problems.customer_reorder(spark, root)
    orders = db.table("orders").df.withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")))
    table = TableSpec("orders", orders, "o_orderkey", "o_orderdate", {"o_custkey": "customer"})
    return DatabaseSpec({**db.tables, "orders": table}), task


@query
def tagg_null_time_keep(spark, root):
    db, task = _partly_dated(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey", lookbacks=[90]))


@query
def tagg_null_time_drop(spark, root):
    db, task = _partly_dated(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey", lookbacks=[90], null_time="drop"))


@query
def tagg_static_child(spark, root):
    """A child without time column counts in full for every seed."""
    customers = TableSpec("customer", read(spark, root, "customer"), "c_custkey", None, {"c_nationkey": "nation"})
    seeds = problems.seed_grid(read(spark, root, "nation"), "n_nationkey", problems.REORDER_SEEDS)
    out = temporal_aggregates(
        seeds, customers, entity_key="n_nationkey", seed_time_col="seed_time", foreign_key="c_nationkey"
    )
    return rounded(out)


@query
def tagg_sweep_7_30_90_all(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(aggregates(db, task, "orders", "o_custkey", lookbacks=SWEEP))


@query
def entity_view(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(views.build_view(db, task, ViewConfig("jt_entity")))


@query
def entity_view_dated(spark, root):
    """A dated entity table: the order's row as of its seed, and its customer."""
    db, task = problems.order_lines(spark, root)
    return rounded(views.build_view(db, task, ViewConfig("jt_entity")))


@query
def temporal_view(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return rounded(views.build_view(db, task, ViewConfig("jt_temporalagg", lookback_days=30)))


@query
def view_inspection(spark, root):
    """The test rows of the temporal view."""
    db, task = problems.customer_reorder(spark, root)
    view = views.build_view(db, with_fixed_split(task), ViewConfig("jt_temporalagg", lookback_days=90))
    return rounded(views.preview(view, "test"))


# Graph features


@query
def degree_temporal(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return degrees.incident_counts(db, task)


def _nation_problem(spark, root) -> tuple[DatabaseSpec, TaskSpec]:
    """Nations with static suppliers and customers, and dated orders by the customer's nation."""
    nation = TableSpec("nation", read(spark, root, "nation"), "n_nationkey")
    customers = read(spark, root, "customer")
    orders = lookup.static_lookup(
        read(spark, root, "orders"), "o_custkey", customers.select("c_custkey", "c_nationkey"), "c_custkey"
    )
    db = DatabaseSpec(
        {
            "nation": nation,
            "customer": TableSpec("customer", customers, "c_custkey", None, {"c_nationkey": "nation"}),
            "supplier": TableSpec(
                "supplier", read(spark, root, "supplier"), "s_suppkey", None, {"s_nationkey": "nation"}
            ),
            "orders": TableSpec("orders", orders, "o_orderkey", "o_orderdate", {"c_nationkey": "nation"}, True),
        }
    )
    seeds = problems.seed_grid(nation.df, "n_nationkey", problems.REORDER_SEEDS).withColumn("label", F.lit(0))
    task = TaskSpec(
        "nation", "classification", "label", "auroc", "nation", "n_nationkey", "seed_time", seeds,
        (min(problems.REORDER_SEEDS), max(problems.REORDER_SEEDS)),
    )
    return db, task


@query
def degree_static(spark, root):
    db, task = _nation_problem(spark, root)
    return degrees.incident_counts(db, task)


@query
def degree_capped(spark, root):
    """A neighbourhood size of 200 admits two of the three incident tables."""
    db, task = _nation_problem(spark, root)
    return views.graph_view(db, task, 200)


def _flat_features(nodes: DataFrame, n: int) -> DataFrame:
    columns = {f"f{i}": F.get("features", F.lit(i)).cast("double") for i in range(n)}
    return rounded(nodes.withColumns(columns).withColumn("n_features", F.size("features").cast("bigint")).drop("features"))


@query
def neighbors_k5_nodes(spark, root):
    db, task = problems.customer_reorder(spark, root)
    nodes = neighbors.neighbor_nodes(db, task, 5)
    return _flat_features(nodes.withColumn("node_idx", F.col("node_idx").cast("bigint")), 3)


@query
def neighbors_all(spark, root):
    """Every order up to the seed."""
    db, task = problems.customer_reorder(spark, root)
    nodes = neighbors.neighbor_nodes(db, task, None).where("node_type = 'orders'")
    return _flat_features(nodes.withColumn("node_idx", F.col("node_idx").cast("bigint")), 3)


def _static_nodes(spark, root, k) -> DataFrame:
    db, task = _nation_problem(spark, root)
    nodes = neighbors.neighbor_nodes(db, task, k).where("node_type IN ('customer', 'supplier')")
    return _flat_features(nodes.withColumn("node_idx", F.col("node_idx").cast("bigint")), 1)


@query
def neighbors_static_k3(spark, root):
    """The first three customers and suppliers of each nation by key: tables without time."""
    return _static_nodes(spark, root, 3)


@query
def neighbors_static_all(spark, root):
    return _static_nodes(spark, root, None)


@query
def neighbors_dated_entity(spark, root):
    """The entity node of a dated table is its row as of the seed, or zeros."""
    db, task = problems.order_lines(spark, root)
    nodes = neighbors.neighbor_nodes(db, task, 1).where(F.col("node_type") == task.entity_table)
    return _flat_features(nodes.withColumn("node_idx", F.col("node_idx").cast("bigint")), 3)


@query
def edge_type_counts(spark, root):
    """Edges of all neighbourhoods by type; types without edges count zero."""
    db, task = problems.user_purchase(spark, root)
    schema = spark.createDataFrame(neighbors.edge_types(db, task), "src_type string, relation string, dst_type string")
    edges = neighbors.neighbor_edges(neighbors.neighbor_nodes(db, task, 3), task)
    counts = edges.groupBy("src_type", "relation", "dst_type").agg(F.count(F.lit(1)).alias("n"))
    joined = schema.join(counts, ["src_type", "relation", "dst_type"], "left")
    return joined.withColumn("n_edges", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


@query
def neighbors_k5_edges(spark, root):
    db, task = problems.user_purchase(spark, root)
    edges = neighbors.neighbor_edges(neighbors.neighbor_nodes(db, task, 5), task)
    return edges.withColumns({c: F.col(c).cast("bigint") for c in ("src_idx", "dst_idx")})


# Dates and keys


def _customer_dates(spark, root) -> DataFrame:
    return dates.spread_dates(read(spark, root, "customer"), "c_custkey", "customer_date")


@query
def entity_date_spread(spark, root):
    return _customer_dates(spark, root)


def _orders_with_offsets(spark, root) -> DataFrame:
    """Negative offsets with a fraction, some missing."""
    return read(spark, root, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderkey") % 11 != 0, -(F.col("o_orderkey") % 977) - F.lit(0.75)).alias("days_before"),
        F.when(F.col("o_orderkey") % 13 != 0, -(F.col("o_orderkey") % 37) - F.lit(0.5)).alias("months_before"),
    )


@query
def relative_day_date(spark, root):
    out = dates.relative_day_dates(
        _orders_with_offsets(spark, root), "c_custkey", "days_before", "event_date", _customer_dates(spark, root)
    )
    return out.select("o_orderkey", "event_date")


@query
def relative_month_date(spark, root):
    out = dates.relative_month_dates(
        _orders_with_offsets(spark, root), "c_custkey", "months_before", "event_date", _customer_dates(spark, root)
    )
    return out.select("o_orderkey", "event_date")


@query
def dense_customer_ids(spark, root):
    return keys.dense_id_map(read(spark, root, "customer"), "c_custkey")


@query
def dense_name_ids(spark, root):
    """Text keys: numbered by range partitions."""
    return keys.dense_id_map(read(spark, root, "customer"), "c_name")


@query
def remapped_orders(spark, root):
    """Orders of customers that are not in the map get a NULL key."""
    id_map = keys.dense_id_map(read(spark, root, "customer").where("c_acctbal > 0"), "c_custkey")
    orders = read(spark, root, "orders").select("o_orderkey", "o_custkey")
    return lookup.remap_foreign_key(orders, "o_custkey", id_map)


@query
def rekeyed_database(spark, root):
    db = problems.star_database(spark, root, ["region", "nation", "customer", "orders"])
    rekeyed, _ = keys.rekey_database(db)
    parts = []
    for name, table in rekeyed.tables.items():
        parent = next(iter(table.foreign_keys), None)
        key = F.col(table.primary_key)
        parts.append(
            table.df.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.min(key).cast("bigint").alias("first_id"),
                F.max(key).cast("bigint").alias("last_id"),
                (F.sum(F.col(parent)) if parent else F.lit(None)).cast("bigint").alias("parent_id_sum"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def line_row_ids(spark, root):
    lines = keys.file_row_ids(read(spark, root, "lineitem"), "line_id")
    return lines.select("line_id", "l_orderkey", "l_partkey", "l_linenumber")


# Splits


@query
def split_70_15_15(spark, root):
    orders = read(spark, root, "orders").select("o_orderkey", "o_orderdate")
    return splits.fractional_split(orders, "o_orderdate")


@query
def split_cutoffs(spark, root):
    names = {"val_cutoff": splits.TRAIN_FRACTION, "test_cutoff": splits.TRAIN_FRACTION + splits.VAL_FRACTION}
    return splits.element_at_fraction(read(spark, root, "lineitem"), "l_shipdate", names)


@query
def split_fixed(spark, root):
    _, task = problems.customer_reorder(spark, root)
    return with_fixed_split(task).task_table


@query
def split_ordered(spark, root):
    """Three split files, written and united in order."""
    _, task = problems.customer_reorder(spark, root)
    rows = with_fixed_split(task).task_table
    out = scratch_path(spark, "splits")
    for name in tables.SPLITS:
        rows.where(F.col("split") == name).drop("split").write.parquet(f"{out}/{name}.parquet")
    loaded = tables.load_split_task(
        spark, out, name="reorder", task_type="classification", target_col="label", entity_table="customer",
        entity_key="c_custkey", seed_time_col="seed_time",
    )
    return loaded.task_table


def _line_blocks(spark, root) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Lines as row-aligned blocks, labels, and two named splits by row number."""
    lines = keys.file_row_ids(read(spark, root, "lineitem"), "row_id")
    block = {
        "num": lines.select("row_id", "l_quantity", "l_extendedprice"),
        "bin": lines.select("row_id", (F.col("l_linestatus") == "O").cast("int").alias("is_open")),
        "cat": lines.select("row_id", "l_linenumber"),
        "meta": lines.select("row_id", "l_partkey", "l_suppkey"),
    }
    labels = lines.select("row_id", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    part = F.when(F.col("row_id") % 10 < 6, "train").when(F.col("row_id") % 10 < 8, "val").otherwise("test")
    index = lines.select(F.lit("by_row").alias("split_name"), part.alias("split"), "row_id").unionByName(
        lines.select(
            F.lit("by_order").alias("split_name"),
            F.when(F.col("l_orderkey") % 4 == 0, "test").otherwise("train").alias("split"),
            "row_id",
        )
    )
    return block, labels, index


@query
def split_indexed(spark, root):
    block, labels, index = _line_blocks(spark, root)
    wide = blocks.assemble_blocks(block, labels, index, "by_row")
    return rounded(wide, 2)


@query
def split_from_block_files(spark, root):
    """Blocks without a key, cut into files in different ways, aligned by position; splits from their files."""
    block, labels, index = _line_blocks(spark, root)
    out = scratch_path(spark, "blocks")
    for files, (name, df) in enumerate(block.items(), 2):
        blocks.write_block(df, ["row_id"], f"{out}/X_{name}.parquet", files)
    parts = index.where("split_name = 'by_row'")
    for part in tables.SPLITS:
        parts.where(F.col("split") == part).select("row_id").write.parquet(f"{out}/split-by_row/{part}_idx.parquet")
    wide = blocks.assemble_blocks(
        blocks.read_blocks(spark, out, include_meta=True), labels, blocks.read_split_index(spark, out), "by_row"
    )
    return rounded(wide, 2)


@query
def available_splits(spark, root):
    return blocks.available_splits(_line_blocks(spark, root)[2])


@query
def split_summary(spark, root):
    _, task = problems.customer_reorder(spark, root)
    return rounded(audit.split_summary(with_fixed_split(task).task_table, "label"), 6)


# Audit


@query
def future_signal(spark, root):
    _, task = problems.customer_reorder(spark, root)
    return audit.future_signal(task.task_table, "seed_time", "label")


@query
def leakage_audit(spark, root):
    """The temporal view of old instances must not change when everything after mid 1998 is deleted."""
    db, task = problems.customer_reorder(spark, root)
    return audit.leakage_audit(
        db,
        task.with_table(task.task_table.select(*task.key_columns, F.lit(0).alias("label"))),
        problems.timestamp(datetime(1998, 7, 1)),
        lambda d, t: views.build_view(d, t, ViewConfig("jt_temporalagg", lookback_days=90)),
    )


@query
def leakage_by_seed(spark, root):
    """The same for every seed against its own past, customers and their parents included."""
    db, task = problems.customer_reorder(spark, root)
    return audit.audit_each_seed(
        db, task, lambda d, t: views.build_view(d, t, ViewConfig("jt_temporalagg", lookback_days=90, max_path_hops=2))
    )


@query
def leakage_asof_rows(spark, root):
    """No row an as-of join picks is dated after its seed."""
    db, task = problems.customer_reorder(spark, root)
    used = asof_join(
        task.task_table, db.table("orders").df, left_key="c_custkey", left_time="seed_time", right_key="o_custkey",
        right_time="o_orderdate", tie="o_orderkey", keep_time=True,
    )
    return audit.rows_after_seed(used, "o_orderdate", "seed_time")


@query
def relational_summary(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return audit.relational_summary(db, with_fixed_split(task))


@query
def summary_json(spark, root):
    """What a relational model is handed, written as JSON and read back."""
    db, task = problems.customer_reorder(spark, root)
    out = scratch_path(spark, "summary")
    payload = audit.relational_payload(db, task)
    sinks.write_json(payload, out)
    back = spark.read.schema(payload.schema).json(out)
    links = F.concat_ws(",", F.sort_array(F.transform(F.map_entries("foreign_keys"), lambda e: F.concat(e["key"], F.lit("->"), e["value"]))))
    return back.withColumns({"columns": F.concat_ws(",", "columns"), "foreign_keys": links})


@query
def preview_rows(spark, root):
    """A view written, read back and looked at: at most 100 rows of a split, none without its label."""
    db, task = problems.customer_reorder(spark, root)
    view = views.build_view(db, with_fixed_split(task), ViewConfig("jt_temporalagg", lookback_days=90))
    path = sinks.write_view(view, scratch_path(spark, "views"), task.name, "jt_temporalagg")
    back = spark.read.parquet(path)
    looks = [
        views.preview(back, split, 100).agg(
            F.lit(split).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label").isNull()).alias("n_unlabelled")
        )
        for split in (*tables.SPLITS, "all")
    ]
    return reduce(lambda a, b: a.unionByName(b), looks)


@query
def block_summary(spark, root):
    block, labels, index = _line_blocks(spark, root)
    wide = blocks.assemble_blocks(block, labels, index, "by_order")
    return rounded(audit.split_summary(wide, "label", blocks.block_features(block)), 6)


# Preprocessing


MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _train_lines(spark, root) -> DataFrame:
    return read(spark, root, "lineitem").where(F.col("l_shipdate") < problems.timestamp(TEST_CUTOFF))


@query
def impute_median(spark, root):
    return rounded(prep.medians(_train_lines(spark, root), MEASURED))


@query
def scale_population(spark, root):
    train = _train_lines(spark, root)
    fill = {row["c"]: row["median"] for row in prep.medians(train, MEASURED).collect()}
    return rounded(prep.scale_stats(train, MEASURED, fill))


@query
def impute_mode(spark, root):
    orders = read(spark, root, "orders")
    return prep.modes(orders, ["o_orderstatus", "o_orderpriority"])


@query
def one_hot_counts(spark, root):
    """Codes from early orders applied to all orders; statuses unseen early have no code."""
    orders = read(spark, root, "orders")
    train = orders.where(F.col("o_orderpriority") > "1-URGENT")
    coded = prep.one_hot_codes(orders, "o_orderpriority", train)
    return coded.groupBy("o_orderpriority", "o_orderpriority__code").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def assembled_entries(spark, root):
    """Entries of the feature vectors of all customers, names included, fitted on part of them."""
    customers = read(spark, root, "customer")
    fitted = prep.TabularPrep("c_acctbal").fit(customers.where("c_nationkey <> 3"))
    entries = fitted.entries(customers).select("c_custkey", F.explode("entries").alias("e"))
    return rounded(entries.select("c_custkey", F.col("e.position").cast("bigint").alias("position"), F.col("e.value").alias("value")))


@query
def impute_nonfinite(spark, root):
    """Ratios with a zero divisor are NaN or infinite; they get the training median."""
    discount = F.col("l_discount")
    ratio = F.when(discount != 0, F.col("l_tax") / discount).otherwise(
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    )
    lines = read(spark, root, "lineitem").withColumn("ratio", ratio)
    train = lines.where(F.col("l_shipdate") < problems.timestamp(TEST_CUTOFF))
    filled = prep.impute_nonfinite(lines, ["ratio"], train)
    return rounded(
        filled.groupBy("l_linestatus").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("ratio").alias("ratio_sum"), F.max("ratio").alias("ratio_max")
        )
    )


@query
def row_cap_sample(spark, root):
    orders = read(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return sample.sample_rows(orders, 1000, ["o_orderkey"], seed=7)


@query
def class_weight(spark, root):
    _, task = problems.customer_reorder(spark, root)
    return rounded(prep.class_weight(task.task_table, "label"), 6)


# Scores


def _scored_reorders(spark, root) -> DataFrame:
    """Label, segment, split and order counts per window: counts serve as scores."""
    db, task = problems.customer_reorder(spark, root)
    counts = aggregates(
        db, task, "orders", "o_custkey", lookbacks=SWEEP, functions=["count", "sum"], columns=["o_totalprice"]
    )
    task = with_fixed_split(task)
    segments = read(spark, root, "customer").select("c_custkey", "c_mktsegment")
    labelled = lookup.lookup(task.task_table, segments, ["c_custkey"])
    return labelled.join(counts, task.key_columns)


def _segment_runs(spark, root) -> DataFrame:
    """AUROC of two scores (count, total) per segment and window, as runs of two models."""
    scored = _scored_reorders(spark, root)
    both = scored.select(
        "label",
        "c_mktsegment",
        "split",
        F.concat(F.lit("window="), F.coalesce(F.col("lookback_days").cast("string"), F.lit("all"))).alias("representation"),
        F.explode(
            F.array(
                F.struct(F.lit("count").alias("model_name"), F.col("orders__row_count").cast("double").alias("score")),
                F.struct(
                    F.lit("total").alias("model_name"),
                    F.round(F.coalesce("orders__o_totalprice__sum", F.lit(0.0)), 2).alias("score"),
                ),
            )
        ).alias("m"),
    ).select("label", "c_mktsegment", "split", "representation", "m.model_name", "m.score")
    by = ["c_mktsegment", "representation", "model_name"]
    scored_runs = scores.auroc(both.where(F.col("split") != "train"), "score", "label", by)
    return scored_runs.select(
        F.col("c_mktsegment").alias("task_name"),
        F.lit("auroc").alias("metric_name"),
        "representation",
        "model_name",
        F.col("auroc").alias("metric_value"),
    )


@query
def auroc_exact(spark, root):
    scored = _scored_reorders(spark, root)
    return rounded(
        scores.auroc(scored, "orders__row_count", "label", ["lookback_days"]), 9
    )


@query
def auroc_missing(spark, root):
    """A scorer that stays silent for rows without history: no AUROC, but the number of such rows."""
    scored = _scored_reorders(spark, root).where("lookback_days is not null")
    silent = scored.withColumn("score", F.when(F.col("orders__row_count") > 0, F.col("orders__row_count")))
    return rounded(scores.auroc(silent, "score", "label", ["lookback_days"]), 9)


@query
def auroc_one_class(spark, root):
    """Segments restricted to positives: no AUROC."""
    scored = _scored_reorders(spark, root).where((F.col("label") == 1) | (F.col("c_mktsegment") == "BUILDING"))
    return rounded(scores.auroc(scored, "orders__row_count", "label", ["c_mktsegment"]), 9)


def _spend_errors(spark, root) -> DataFrame:
    """Last half year's spend as the prediction of the next half year's."""
    db, task = problems.customer_spend(spark, root)
    past = aggregates(
        db, task, "orders", "o_custkey", lookbacks=[180], functions=["sum"], columns=["o_totalprice"], recency=False
    )
    joined = task.task_table.join(past, task.key_columns)
    return joined.withColumn("prediction", F.coalesce("orders__o_totalprice__sum", F.lit(0.0)))


@query
def mae(spark, root):
    return rounded(scores.mae(_spend_errors(spark, root), "prediction", "label", ["seed_time"]))


@query
def utility(spark, root):
    errors = scores.mae(_spend_errors(spark, root), "prediction", "label", ["seed_time"])
    cost = errors.select(
        F.col("seed_time").cast("string").alias("run"), F.lit("mae").alias("metric_name"), F.col("mae").alias("metric_value")
    )
    runs = cost.unionByName(
        _segment_runs(spark, root).select(
            F.concat_ws("|", "task_name", "representation", "model_name").alias("run"), "metric_name", "metric_value"
        )
    )
    return rounded(runs.withColumn("utility", scores.utility(F.col("metric_value"), F.col("metric_name"))), 6)


@query
def best_per_representation(spark, root):
    return rounded(invariance.best_per_representation(_segment_runs(spark, root)), 6)


@query
def normalized_utilities(spark, root):
    best = invariance.best_per_representation(_segment_runs(spark, root))
    return rounded(invariance.normalized_utilities(best), 6)


@query
def ris_by_task(spark, root):
    return rounded(invariance.ris_by_task(_segment_runs(spark, root)), 6)


@query
def macro_ris(spark, root):
    return rounded(invariance.macro_ris(invariance.ris_by_task(_segment_runs(spark, root))), 6)


@query
def metric_override(spark, root):
    """Scores given from outside replace computed ones."""
    none = F.lit(None).cast("double")
    runs = _segment_runs(spark, root).withColumns(
        {
            "precomputed_test_metric": F.when(F.col("model_name") == "total", F.lit(0.77)).otherwise(none),
            "precomputed_metric": F.when(F.col("task_name") == "BUILDING", F.lit(0.66)).otherwise(none),
            "metric_override": F.when(F.col("representation") == "window=all", F.lit(0.55)).otherwise(none),
        }
    )
    out = protocol.override_metric(runs)
    return rounded(out.select("task_name", "representation", "model_name", "metric_value"), 6)


@query
def constant_baseline(spark, root):
    _, task = problems.customer_spend(spark, root)
    rows = with_fixed_split(task).task_table
    mean = prep.target_mean(rows.where(F.col("split") == "train"), "label").scalar()
    predicted = rows.where(F.col("split") == "test").withColumn("prediction", mean)
    return rounded(predicted.select("c_custkey", "seed_time", "label", "prediction"))


# Files written and read back; the contents are derived from the tables


def _segment_results(spark, root) -> DataFrame:
    """One result document per segment and split, as a sweep would leave behind."""
    scored = _scored_reorders(spark, root).where(F.col("lookback_days").isNull())
    by = scores.auroc(scored, "orders__row_count", "label", ["c_mktsegment", "split"])
    pivot = by.groupBy("c_mktsegment").agg(
        *[F.max(F.when(F.col("split") == s, F.col("n_pos") + F.col("n_neg"))).alias(s) for s in tables.SPLITS],
        *[F.max(F.when(F.col("split") == s, F.col("auroc"))).alias(f"{s}_auroc") for s in ("val", "test")],
    )
    return pivot.select(
        "c_mktsegment",
        F.when(F.col("c_mktsegment") < "F", "early").otherwise("late").alias("split"),
        F.lit(1).cast("bigint").alias("n_features"),
        F.struct(*tables.SPLITS).alias("n_rows"),
        F.struct("val_auroc", "test_auroc").alias("metrics"),
    )


def _collected_sweep(spark, root) -> DataFrame:
    """Write the results one folder per run, then collect them."""
    out = scratch_path(spark, "sweep-results")
    documents = _segment_results(spark, root)
    text = F.to_json(F.struct(*[c for c in documents.columns if c != "c_mktsegment"]))
    lines = documents.select("c_mktsegment", text.alias("value")).collect()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(hadoop)
    for row in lines:  # a handful of run folders, as many as there are segments
        stream = fs.create(path(f"{out}/{row['c_mktsegment']}/result.json"))
        stream.write(bytearray(row["value"], "utf-8"))
        stream.close()
    return sweeps.read_sweep_results(spark, out)


@query
def sweep_json_collect(spark, root):
    return rounded(
        _collected_sweep(spark, root).select(
            "task", "split", "seed", "n_features", "n_train", "n_val", "n_test", "val_auroc", "test_auroc"
        ),
        6,
    )


@query
def sweep_mean_std(spark, root):
    return rounded(sweeps.summarize_sweep(_collected_sweep(spark, root)), 6)


def _csv_problem(spark, root) -> tuple[DatabaseSpec, TaskSpec]:
    """Customers and orders written as CSV with day offsets instead of dates, then loaded."""
    out = scratch_path(spark, "csv")
    customers = read(spark, root, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 3, (F.col("c_acctbal") > 5000).cast("int")).alias("rich"),
        "c_nationkey",
        "c_mktsegment",
    )
    orders = _orders_with_offsets(spark, root).drop("months_before")
    sinks.write_csv(customers, f"{out}/customers.csv")
    sinks.write_csv(orders, f"{out}/orders.csv")
    layout = csvdb.CsvProblem(
        name="csv_rich",
        entity_key="c_custkey",
        target_col="rich",
        date_col="customer_date",
        tables={
            "customers": csvdb.CsvTable(
                "customers.csv", "c_custkey bigint, rich int, c_nationkey bigint, c_mktsegment string", primary_key="c_custkey"
            ),
            "orders": csvdb.CsvTable(
                "orders.csv",
                "o_orderkey bigint, c_custkey bigint, days_before double",
                primary_key="o_orderkey",
                offset=("days_before", "event_date", 1),
                foreign_keys={"c_custkey": "customers"},
            ),
        },
    )
    return csvdb.load_csv_problem(spark, out, layout)


@query
def csv_task(spark, root):
    return _csv_problem(spark, root)[1].task_table.select("c_custkey", "customer_date", "rich", "split")


@query
def csv_child_dates(spark, root):
    return _csv_problem(spark, root)[0].table("orders").df.select("o_orderkey", "c_custkey", "event_date")


def _credit_problem(spark, root) -> tuple[DatabaseSpec, TaskSpec, dict[str, DataFrame]]:
    """The seven-table credit layout, filled from customers, orders and lines, with declared schemas."""
    out = scratch_path(spark, "credit")
    customers = read(spark, root, "customer")
    orders = read(spark, root, "orders")
    lines = read(spark, root, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    even, number = F.col("o_orderkey") % 2 == 0, F.col("l_linenumber")
    ids = [F.col("l_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR")]
    months = (-number).alias("MONTHS_BALANCE")
    rows = {
        "application": customers.select(
            F.col("c_custkey").alias("SK_ID_CURR"),
            F.when(F.col("c_nationkey") != 3, (F.col("c_acctbal") > 5000).cast("int")).alias("TARGET"),
            F.col("c_acctbal").alias("AMT_CREDIT"),
        ),
        "bureau": orders.where(even).select(
            F.col("o_orderkey").alias("SK_ID_BUREAU"),
            F.col("o_custkey").alias("SK_ID_CURR"),
            (-(F.col("o_orderkey") % 977)).alias("DAYS_CREDIT"),
            F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("AMT_CREDIT_SUM"),
        ),
        "bureau_balance": lines.where(even).select(F.col("l_orderkey").alias("SK_ID_BUREAU"), months, F.col("l_linestatus").alias("STATUS")),
        "previous_application": orders.where(~even).select(
            F.col("o_orderkey").alias("SK_ID_PREV"),
            F.col("o_custkey").alias("SK_ID_CURR"),
            (-(F.col("o_orderkey") % 500)).alias("DAYS_DECISION"),
        ),
        "pos_cash_balance": lines.where(~even & (number <= 2)).select(*ids, months),
        "credit_card_balance": lines.where(~even & number.between(3, 4)).select(*ids, months),
        "installments_payments": lines.where(~even & (number > 4)).select(
            *ids, F.when(F.col("l_partkey") % 7 != 0, -(F.col("l_partkey") % 300) - F.lit(0.5)).alias("DAYS_INSTALMENT")
        ),
    }
    layout = {}
    for name, table in csvdb.CREDIT.tables.items():
        df = rows[name]
        order = [c for c in ("SK_ID_BUREAU", "SK_ID_PREV", "MONTHS_BALANCE", "STATUS", "DAYS_INSTALMENT", "SK_ID_CURR") if c in df.columns]
        sinks.write_csv(df.repartitionByRange(5, *order).sortWithinPartitions(*order), f"{out}/{table.file}")
        kinds = {"AMT_CREDIT_SUM": "double"}
        schema = ", ".join(f"{f.name} {kinds.get(f.name, f.dataType.simpleString())}" for f in df.schema.fields)
        layout[name] = replace(table, schema=schema, infer=False)
    bad: dict[str, DataFrame] = {}
    db, task = csvdb.load_csv_problem(spark, out, replace(csvdb.CREDIT, tables=layout), bad)
    return db, task, bad


@query
def csv_credit_view(spark, root):
    """Seven CSV tables with dates by day and by month and made-up row ids, to a temporal view."""
    db, task, _ = _credit_problem(spark, root)
    view = views.build_view(db, task, ViewConfig("jt_temporalagg", lookback_days=200, aggregation_functions=("count",)))
    counts = [c for c in view.columns if c.endswith(("__row_count", "__recency_days"))]
    return rounded(view.select(*task.key_columns, task.target_col, "split", "application__AMT_CREDIT", *counts))


@query
def csv_bad_rows(spark, root):
    """Lines that do not fit their table's schema, by table, beside those that do."""
    db, _, bad = _credit_problem(spark, root)
    counted = [
        table.df.select(F.lit(name).alias("table_name"), F.lit(0).alias("b")).unionByName(
            bad[name].select(F.lit(name).alias("table_name"), F.lit(1).alias("b"))
        )
        for name, table in db.tables.items()
    ]
    every = reduce(lambda a, b: a.unionByName(b), counted)
    return every.groupBy("table_name").agg(
        F.count_if(F.col("b") == 0).alias("n_rows"), F.count_if(F.col("b") == 1).alias("n_bad")
    )


@query
def csv_row_ids(spark, root):
    """Row ids of a folder of CSV files, in file order."""
    db, _, _ = _credit_problem(spark, root)
    return db.table("bureau_balance").df


@query
def exported_tasks(spark, root):
    """The re-keyed export, read back."""
    db, task = problems.customer_reorder(spark, root)
    out = scratch_path(spark, "export")
    sinks.export_relational(spark, db, with_fixed_split(task), out)
    parts = {s: spark.read.parquet(f"{out}/tasks/{task.name}/{s}.parquet") for s in tables.SPLITS}
    return tables.union_splits(parts)


# Models; nothing to compare with in SQL, except for the plug-in scorer


def _model_problem(spark, root):
    db, task = problems.customer_reorder(spark, root)
    return db, with_fixed_split(task)


@query
def plugin_scores(spark, root):
    """A Python scorer over Arrow batches."""
    db, task = problems.customer_reorder(spark, root)
    counts = aggregates(db, task, "orders", "o_custkey", lookbacks=[90], functions=["count"], recency=False)
    out = models.score_batches(counts, lambda pdf: pdf["orders__row_count"] / (1 + pdf["orders__row_count"]), ["orders__row_count"])
    return rounded(out.drop("lookback_days"), 6)


@query
def gbt_scores(spark, root):
    db, task = _model_problem(spark, root)
    config = ViewConfig("jt_temporalagg", lookback_days=90)
    view = protocol.materialize(views.build_view(db, task, config), "gbt")
    model = models.SparkTabularModel("gbt", models.boosted_trees("classification"), validate=True)
    train, val, test = (view.where(F.col("split") == s) for s in tables.SPLITS)
    model.fit(train, val, task)
    scored = model.predict(test, task)
    return scored.select(*task.key_columns, "label", F.col("prediction").between(0, 1).alias("is_probability"))


def _linear(task: TaskSpec) -> models.SparkTabularModel:
    return models.SparkTabularModel("linear", models.linear_model(task.task_type))


@query
def protocol_a(spark, root):
    db, task = _model_problem(spark, root)
    summary = protocol.run_protocol_a(
        db, task, [_linear(task)], [models.ConstantModel()], [_linear(task)]
    )
    return summary.runs.drop("compute", "extra")


def _column_model(*names: str) -> models.CallbackModel:
    """Scores rows by the first of the columns that the data has; learns nothing."""

    def predict(state, data, task):
        rows = models.rows_of(data)
        name = next(c for c in names if c in rows.columns)
        return rows.withColumn(models.PREDICTION, F.col(name).cast("double"))

    return models.CallbackModel(names[-1], lambda train, val, task: (None, {}), predict)


def _column_protocol(spark, root) -> protocol.ProtocolSummary:
    db, task = _model_problem(spark, root)
    joined = _column_model("orders__row_count", "customer__c_acctbal")
    relational, graph = _column_model("c_custkey"), _column_model("graphdeg__orders__count_leq_seed")
    return protocol.run_protocol_a(db, task, [joined], [relational], [graph])


@query
def protocol_a_columns(spark, root):
    """Protocol A with models that score by one column: runs that SQL can follow."""
    return rounded(_column_protocol(spark, root).runs.drop("compute", "extra"))


@query
def protocol_a_scores(spark, root):
    """The scores that the invariance of protocol A is computed from, beside it."""
    ris = _column_protocol(spark, root).ris
    return rounded(ris.select("task_name", "n_representations", "ris", F.explode("representation_scores").alias("representation", "score")))


@query
def protocol_b_columns(spark, root):
    """Protocol B with models that score by one column, on every setting of the views."""
    db, task = _model_problem(spark, root)
    joined = _column_model("orders__row_count", "customer__c_acctbal")
    graph = _column_model("graphdeg__orders__count_leq_seed")
    return rounded(protocol.run_protocol_b(db, task, [joined], lambda k: [graph]).runs.drop("compute", "extra"))


@query
def sigmoid_scores(spark, root):
    """Balances as log-odds."""
    customers = read(spark, root, "customer")
    return rounded(customers.select("c_custkey", sigmoid(F.col("c_acctbal") / 1000 - 1).alias("probability")))


@query
def protocol_b(spark, root):
    db, task = _model_problem(spark, root)
    summary = protocol.run_protocol_b(db, task, [_linear(task)], lambda k: [_linear(task)])
    return summary.ris
