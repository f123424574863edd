import random
from datetime import datetime, timedelta

import pandas as pd

from seedview.functions.expressions import naive_timestamp
from seedview.model import DatabaseSpec, TableSpec, TaskSpec

DAY0 = datetime(2024, 1, 1)


def frame(spark, rows, schema, times=()):
    """A DataFrame whose ``times`` columns are given as text or datetime and become NTZ timestamps."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    plain = [tuple(v.isoformat(" ") if isinstance(v, datetime) else v for v in row) for row in rows]
    df = spark.createDataFrame(plain, schema)
    return df.withColumns({c: naive_timestamp(c) for c in times}) if times else df.select(*names)


def random_history(seed, n_users=4, n_rows=120, n_seeds=40):
    """Child rows and seeds with NULL keys, NULL times, NULL values, ties and duplicate instances."""
    rng = random.Random(seed)

    def moment():
        return DAY0 + timedelta(hours=rng.randrange(0, 24 * 40))

    children = [
        (
            i,
            rng.choice([1, 1, 1, 1] + list(range(1, n_users + 1)) + [None]),
            None if rng.random() < 0.1 else moment(),
            None if rng.random() < 0.15 else rng.randrange(-50, 50) / 4,
            rng.choice(["a", "b", "c", None]),
            rng.random() < 0.5,
        )
        for i in range(n_rows)
    ]
    seeds = [(rng.randrange(1, n_users + 2), moment()) for _ in range(n_seeds)]
    for row in rng.sample(children, 15):  # seeds on row times, and a window later
        if row[1] is not None and row[2] is not None:
            seeds += [(row[1], row[2]), (row[1], row[2] + timedelta(days=7))]
    return children, seeds


CHILD_SCHEMA = "tx_id bigint, user_id bigint, t string, x double, kind string, flag boolean"


def history_frames(spark, children, seeds):
    child = frame(spark, children, CHILD_SCHEMA, ["t"])
    instances = frame(spark, seeds, "user_id bigint, seed_time string", ["seed_time"])
    return child, instances


def problem(spark, entity_rows, entity_schema, child, instances, entity_time=None, label=0):
    from pyspark.sql import functions as F

    users = frame(spark, entity_rows, entity_schema, [entity_time] if entity_time else [])
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id", entity_time),
            "tx": TableSpec("tx", child, "tx_id", "t", {"user_id": "users"}),
        }
    )
    table = instances.withColumn("label", F.lit(label))
    return db, TaskSpec("p", "classification", "label", "auroc", "users", "user_id", "seed_time", table)


def sorted_rows(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def is_missing(value):
    return value is None or pd.isna(value)
