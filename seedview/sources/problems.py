"""Prediction problems over the star-schema test tables, and a toy problem."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedview.functions.expressions import add_days, naive_timestamp
from seedview.model import DatabaseSpec, TableSpec, TaskSpec
from seedview.operators.keys import file_row_ids
from seedview.sources.tables import TableEntry, load_database

Problem = tuple[DatabaseSpec, TaskSpec]

REORDER_SEEDS = tuple(datetime(year, 7, 1) for year in range(1996, 2001))
PURCHASE_SEEDS = tuple(datetime(2024, 1, day) for day in (10, 15, 20, 25))
REORDER_HORIZON_DAYS = 180
PURCHASE_HORIZON_DAYS = 3

STAR = {
    "region": TableEntry("region.parquet", "r_regionkey"),
    "nation": TableEntry("nation.parquet", "n_nationkey", None, {"n_regionkey": "region"}),
    "customer": TableEntry("customer.parquet", "c_custkey", None, {"c_nationkey": "nation"}),
    "orders": TableEntry("orders.parquet", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}, True),
    "events": TableEntry("events.parquet", "event_id", "ts", {"user_id": "customer"}, True),
}


def star_database(spark: SparkSession, root: str, tables: Sequence[str]) -> DatabaseSpec:
    return load_database(spark, root, {name: STAR[name] for name in tables})


def timestamp(moment: datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def seed_grid(entities: DataFrame, key: str, seeds: Sequence[datetime]) -> DataFrame:
    """Every entity at every seed time."""
    return entities.select(key, F.explode(F.array(*[timestamp(s) for s in seeds])).alias("seed_time"))


def labelled_by_future(
    instances: DataFrame,
    events: DataFrame,
    *,
    key: str,
    foreign_key: str,
    time_col: str,
    seeds: Sequence[datetime],
    horizon_days: int,
    value,
) -> DataFrame:
    """Attach ``label``: the sum of ``value`` over events in ``(seed, seed + horizon]``.

    Events meet the few seeds of the grid, not the instances, so the sum is combined map-side
    before anything is shuffled.
    """
    horizon = timedelta(days=horizon_days)
    inside = F.filter(
        F.array(*[timestamp(s) for s in seeds]),
        lambda s: (F.col(time_col) > s) & (F.col(time_col) <= add_days(s, F.lit(horizon_days))),
    )
    future = (
        events.where((F.col(time_col) > timestamp(min(seeds))) & (F.col(time_col) <= timestamp(max(seeds) + horizon)))
        .select(F.col(foreign_key).alias(key), value.alias("__v"), F.explode(inside).alias("seed_time"))
        .groupBy(key, "seed_time")
        .agg(F.sum("__v").alias("label"))
    )
    return instances.join(future, [key, "seed_time"], "left")


def _task(name, task_type, metric, entity, key, table, seeds=None) -> TaskSpec:
    seed_range = (min(seeds), max(seeds)) if seeds else None
    return TaskSpec(name, task_type, "label", metric, entity, key, "seed_time", table, seed_range)


def customer_reorder(spark: SparkSession, root: str) -> Problem:
    """Does a customer order again within 180 days?"""
    db = star_database(spark, root, ["customer", "nation", "region", "orders"])
    grid = seed_grid(db.table("customer").df, "c_custkey", REORDER_SEEDS)
    labelled = labelled_by_future(
        grid,
        db.table("orders").df,
        key="c_custkey",
        foreign_key="o_custkey",
        time_col="o_orderdate",
        seeds=REORDER_SEEDS,
        horizon_days=REORDER_HORIZON_DAYS,
        value=F.lit(1),
    )
    table = labelled.withColumn("label", F.col("label").isNotNull().cast("int"))
    return db, _task("customer_reorder", "classification", "auroc", "customer", "c_custkey", table, REORDER_SEEDS)


def customer_spend(spark: SparkSession, root: str) -> Problem:
    """How much does a customer order within 180 days?"""
    db = star_database(spark, root, ["customer", "nation", "region", "orders"])
    grid = seed_grid(db.table("customer").df, "c_custkey", REORDER_SEEDS)
    labelled = labelled_by_future(
        grid,
        db.table("orders").df,
        key="c_custkey",
        foreign_key="o_custkey",
        time_col="o_orderdate",
        seeds=REORDER_SEEDS,
        horizon_days=REORDER_HORIZON_DAYS,
        value=F.col("o_totalprice"),
    )
    table = labelled.withColumn("label", F.coalesce("label", F.lit(0.0)))
    return db, _task("customer_spend", "regression", "mae", "customer", "c_custkey", table, REORDER_SEEDS)


def user_purchase(spark: SparkSession, root: str) -> Problem:
    """Does an active user purchase within three days?"""
    db = star_database(spark, root, ["customer", "nation", "region", "events"])
    events = db.table("events").df
    users = db.table("customer").df.join(
        events.select(F.col("user_id").alias("c_custkey")).distinct(), "c_custkey", "left_semi"
    )
    labelled = labelled_by_future(
        seed_grid(users, "c_custkey", PURCHASE_SEEDS),
        events.where(F.col("event_type") == "purchase"),
        key="c_custkey",
        foreign_key="user_id",
        time_col="ts",
        seeds=PURCHASE_SEEDS,
        horizon_days=PURCHASE_HORIZON_DAYS,
        value=F.lit(1),
    )
    table = labelled.withColumn("label", F.col("label").isNotNull().cast("int"))
    return db, _task("user_purchase", "classification", "auroc", "customer", "c_custkey", table, PURCHASE_SEEDS)


def order_lines(spark: SparkSession, root: str) -> Problem:
    """Is any line shipped later than 30 days after the order returned?"""
    base = star_database(spark, root, ["customer", "nation", "region", "orders"])
    lines = file_row_ids(spark.read.parquet(f"{root}/lineitem.parquet"), "line_id")
    lineitem = TableSpec("lineitem", lines, "line_id", "l_shipdate", {"l_orderkey": "orders"}, True)
    db = DatabaseSpec({**base.tables, "lineitem": lineitem})
    seeds = base.table("orders").df.select(
        "o_orderkey", add_days(F.col("o_orderdate"), F.lit(30)).alias("seed_time")
    )
    returned = lines.where(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("__last"))
    table = seeds.join(returned.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").select(
        "o_orderkey", "seed_time", F.coalesce(F.col("__last") > F.col("seed_time"), F.lit(False)).cast("int").alias("label")
    )
    return db, _task("order_lines", "classification", "auroc", "orders", "o_orderkey", table)


def toy_churn(spark: SparkSession) -> Problem:
    """Five users, fifteen transactions, ten instances: the fixture of the tests."""
    users = spark.createDataFrame(
        [(u, c, a, f"2024-01-0{u}") for u, c, a in [(1, "NL", 25), (2, "DE", 34), (3, "FR", 41), (4, "NL", 29), (5, "DE", 52)]],
        "user_id bigint, country string, age bigint, updated_at string",
    ).withColumn("updated_at", naive_timestamp("updated_at"))
    transactions = spark.createDataFrame(
        [
            (i + 1, i % 5 + 1, 10 + 7 * i, "web" if i % 2 else "app", (datetime(2024, 1, 10) + timedelta(days=5 * i)).isoformat(" "))
            for i in range(15)
        ],
        "tx_id bigint, user_id bigint, amount bigint, channel string, event_time string",
    ).withColumn("event_time", naive_timestamp("event_time"))
    table = spark.createDataFrame(
        [(u, s, (u + i) % 2) for i, s in enumerate(["2024-02-15", "2024-03-16"]) for u in range(1, 6)],
        "user_id bigint, seed_time string, label int",
    ).withColumn("seed_time", naive_timestamp("seed_time"))
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id", "updated_at"),
            "transactions": TableSpec("transactions", transactions, "tx_id", "event_time", {"user_id": "users"}),
        }
    )
    return db, _task("toy_churn", "classification", "auroc", "users", "user_id", table)
