"""Windowed child aggregates against hand-made cases and a brute-force loop."""

from datetime import datetime, timedelta

import pytest
from helpers import frame, history_frames, is_missing, random_history

from seedview.model import TableSpec
from seedview.operators import running as running_module
from seedview.operators.degrees import incident_counts
from seedview.operators.temporal_agg import temporal_aggregates
from seedview.session import SkewPolicy
from seedview.sources.problems import toy_churn


def aggregates(instances, child, lookbacks, **options):
    table = TableSpec("tx", child, "tx_id", options.pop("time_col", "t"), {"user_id": "users"})
    return temporal_aggregates(
        instances, table, entity_key="user_id", seed_time_col="seed_time", foreign_key="user_id", lookbacks=lookbacks, **options
    )


def test_no_history_gives_zero_counts_and_null_recency(spark):
    child = frame(
        spark,
        [(1, 1, "2024-01-15", 10.0), (2, 3, "2024-03-05", 99.0)],
        "tx_id bigint, user_id bigint, t string, amount double",
        ["t"],
    )
    seeds = frame(spark, [(u, "2024-02-01") for u in (1, 2, 3)], "user_id bigint, seed_time string", ["seed_time"])
    rows = aggregates(seeds, child, [30]).orderBy("user_id").collect()
    assert [r.tx__row_count for r in rows] == [1, 0, 0]
    assert [r.tx__recency_days for r in rows] == [17.0, None, None]
    assert [r.tx__amount__sum for r in rows] == [10.0, None, None]


def test_published_example(spark):
    """Driver 12 on 2004-08-04 with a 30 day window."""
    qualifying = [(1, 12, "2004-07-24", 16), (2, 12, "2004-07-10", 11), (3, 12, "2004-06-20", 5), (4, 12, "2004-08-14", 1)]
    child = frame(spark, qualifying, "tx_id bigint, user_id bigint, t string, position int", ["t"])
    seeds = frame(spark, [(12, "2004-08-04")], "user_id bigint, seed_time string", ["seed_time"])
    row = aggregates(seeds, child, [30]).first()
    assert (row.tx__row_count, row.tx__recency_days, row.tx__position__mean) == (2, 11.0, 13.5)


def test_both_window_ends_are_inclusive(spark, skew_mode):
    seed = datetime(2024, 3, 1, 12)
    times = [seed - timedelta(days=7, microseconds=1), seed - timedelta(days=7), seed, seed + timedelta(microseconds=1)]
    child = frame(
        spark, [(i, 1, t, 1.0) for i, t in enumerate(times)], "tx_id bigint, user_id bigint, t string, x double", ["t"]
    )
    seeds = frame(spark, [(1, seed)], "user_id bigint, seed_time string", ["seed_time"])
    found = {r.lookback_days: r.tx__row_count for r in aggregates(seeds, child, [0, 7, None]).collect()}
    assert found == {0: 1, 7: 2, None: 3}


def brute_force(children, user, seed, lookback, keep):
    rows = [
        c
        for c in children
        if c[1] == user
        and ((keep and c[2] is None) or (c[2] is not None and c[2] <= seed and (lookback is None or c[2] >= seed - timedelta(days=lookback))))
    ]
    times = [c[2] for c in rows if c[2] is not None]
    values = [c[3] for c in rows if c[3] is not None]
    flags = [float(c[5]) for c in rows]
    return {
        "tx__row_count": len(rows),
        "tx__recency_days": (seed - max(times)).total_seconds() / 86400 if times else None,
        "tx__x__mean": sum(values) / len(values) if values else None,
        "tx__x__sum": sum(values) if values else None,
        "tx__x__min": min(values) if values else None,
        "tx__x__max": max(values) if values else None,
        "tx__flag__mean": sum(flags) / len(flags) if flags else None,
        "tx__kind__nunique": len({c[4] for c in rows} - {None}),
    }


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("null_time", ["keep", "drop"])
def test_random_histories(spark, skew_mode, seed, null_time):
    children, seeds = random_history(seed)
    child, instances = history_frames(spark, children, seeds)
    lookbacks = [0, 1, 7, None]
    got = aggregates(instances, child, lookbacks, null_time=null_time).collect()
    assert len(got) == len(set(seeds)) * len(lookbacks)
    for row in got:
        want = brute_force(children, row.user_id, row.seed_time, row.lookback_days, null_time == "keep")
        for name, value in want.items():
            if is_missing(value):
                assert row[name] is None, (row, name)
            else:
                assert row[name] == pytest.approx(value, abs=1e-9), (row, name)


def test_seed_range_only_prunes(spark, skew_mode):
    children, seeds = random_history(5)
    child, instances = history_frames(spark, children, seeds)
    bounds = (min(s for _, s in seeds), max(s for _, s in seeds))
    free = aggregates(instances, child, [1, 7, None])
    bounded = aggregates(instances, child, [1, 7, None], seed_range=bounds)
    assert free.exceptAll(bounded).isEmpty() and bounded.exceptAll(free).isEmpty()


def test_wrong_seed_range_removes_nothing(spark, skew_mode):
    children, seeds = random_history(6)
    child, instances = history_frames(spark, children, seeds)
    wrong = (datetime(1990, 1, 1), datetime(1990, 1, 2))
    free = aggregates(instances, child, [1, 7, None])
    hinted = aggregates(instances, child, [1, 7, None], seed_range=wrong)
    assert free.exceptAll(hinted).isEmpty() and hinted.exceptAll(free).isEmpty()
    none = aggregates(instances.limit(0), child, [1], seed_range=wrong)
    assert none.count() == 0


def test_static_child_counts_for_every_seed(spark, skew_mode):
    child = frame(
        spark, [(1, 1, 2.0, "a"), (2, 1, None, "a"), (3, 1, 4.0, "b"), (4, None, 9.0, "z")],
        "tx_id bigint, user_id bigint, x double, kind string",
    )
    seeds = frame(
        spark, [(1, "2024-01-01"), (1, "2025-01-01"), (2, "2024-01-01")], "user_id bigint, seed_time string", ["seed_time"]
    )
    rows = aggregates(seeds, child, [30], time_col=None).orderBy("user_id", "seed_time").collect()
    assert [(r.tx__row_count, r.tx__x__mean, r.tx__kind__nunique) for r in rows] == [(3, 3.0, 2), (3, 3.0, 2), (0, None, 0)]
    assert "tx__recency_days" not in rows[0]


def test_count_grows_with_the_window_and_ends_at_the_degree(spark):
    children, seeds = random_history(7)
    child, instances = history_frames(spark, children, seeds)
    found = aggregates(instances, child, [1, 7, 30, None], null_time="drop").collect()
    counts = {}
    for row in found:
        counts.setdefault((row.user_id, row.seed_time), {})[row.lookback_days] = row.tx__row_count
    assert all(c[1] <= c[7] <= c[30] <= c[None] for c in counts.values())
    from helpers import problem

    db, task = problem(spark, [(u,) for u in range(1, 6)], "user_id bigint", child, instances)
    for row in incident_counts(db, task).collect():
        assert row.graphdeg__tx__count_leq_seed == counts[row.user_id, row.seed_time][None]


def test_selected_functions(spark):
    children, seeds = random_history(3)
    child, instances = history_frames(spark, children, seeds)
    out = aggregates(instances, child, [7], functions=["mean"], recency=False)
    assert out.columns == ["user_id", "seed_time", "lookback_days", "tx__tx_id__mean", "tx__x__mean", "tx__flag__mean"]
    with pytest.raises(ValueError):
        aggregates(instances, child, [7], null_time="maybe")


def test_nan_is_missing(spark):
    child = frame(
        spark, [(1, 1, "2024-01-01", float("nan")), (2, 1, "2024-01-02", 3.0)],
        "tx_id bigint, user_id bigint, t string, x double", ["t"],
    )
    seeds = frame(spark, [(1, "2024-02-01")], "user_id bigint, seed_time string", ["seed_time"])
    row = aggregates(seeds, child, [None]).first()
    assert (row.tx__row_count, row.tx__x__sum, row.tx__x__max) == (2, 3.0, 3.0)


def test_one_key_with_a_third_of_all_rows_is_cut(spark):
    """A hot key is split into slices whose sizes stay near a fair share, and results stay right."""
    from pyspark.sql import functions as F

    from seedview.operators.running import POS, PROBE, SLICE, _cut_points, _slice_number, hot_groups, running
    from seedview.session import SkewPolicy

    rows = spark.range(30000).select(
        F.when(F.col("id") < 10000, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"),
        (F.col("id") * 7919 % 30011).alias(POS),
        F.lit(False).alias(PROBE),
        F.lit(1).cast("bigint").alias("n"),
    )
    policy = SkewPolicy(active=True, min_rows=100, fair=10, slices=20)
    hot = hot_groups(rows, ["k"], policy)
    assert [r.k for r in hot.collect()] == [-1]
    cuts = _cut_points(rows, ["k"], hot, policy)
    sizes = rows.join(cuts, "k").groupBy(_slice_number().alias(SLICE)).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 10000 / 20 * 1.5
    sliced = running(rows, ["k"], {"n": "sum"}, skew=policy, collapse=False)
    assert sliced.groupBy("k").agg(F.max("asc__n").alias("m"), F.count("*").alias("c")).where("m <> c").isEmpty()


def test_large_inputs_are_dealt_into_parts_of_their_own(spark):
    """Seeds before they are repeated per window and rows before they are sorted, not as the planner joins them."""
    db, task = toy_churn(spark)
    options = dict(entity_key="user_id", seed_time_col="seed_time", foreign_key="user_id", lookbacks=[7, None])
    policy = SkewPolicy(active=True, min_rows=1_000_000, fair=4, slices=64, grid=0, parts=7)
    dealt = temporal_aggregates(task.task_table, db.table("transactions"), skew=policy, **options)
    plain = temporal_aggregates(task.task_table, db.table("transactions"), **options)
    by_number = [line for line in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(by_number) >= 2 and all(", 7)" in line for line in by_number)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("grid", [0, 1000])
def test_events_are_not_probed_if_keys_are_small(spark, monkeypatch, grid):
    child, instances = history_frames(spark, *random_history(5))
    probed = []
    monkeypatch.setattr(running_module, "hot_groups", lambda rows, by, skew: probed.append(by))
    found = {}
    for rows in (1_000_000, 10):
        policy = SkewPolicy(active=True, min_rows=rows, fair=1, slices=4, grid=grid, parts=3)
        got = aggregates(instances, child, [7, None], null_time="drop", skew=policy)
        found[rows] = sorted(map(str, got.collect())), len(probed)
    assert found[1_000_000][1] == 0 and found[10][1] == 1
    assert found[1_000_000][0] == found[10][0] and found[10][0]


def test_the_halves_of_a_window_meet_in_dealt_parts(spark):
    """Small partitions as sent are joined by adaptive execution; what is merged and joined in them stays dealt."""
    db, task = toy_churn(spark)
    policy = SkewPolicy(active=True, min_rows=1_000_000, fair=4, slices=64, grid=0, parts=7)
    out = temporal_aggregates(
        task.task_table, db.table("transactions"), entity_key="user_id", seed_time_col="seed_time",
        foreign_key="user_id", lookbacks=[30, None], functions=["count"], null_time="drop", skew=policy,
    )
    assert out.count() == 20 and out.rdd.getNumPartitions() == 7
