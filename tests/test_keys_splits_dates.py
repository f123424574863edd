"""Dense keys, splits, synthetic and relative dates, samples, audits."""

from datetime import date, datetime

import pytest
from helpers import frame
from pyspark.sql import functions as F

from seedview.model import ViewConfig
from seedview.operators import audit
from seedview.operators.dates import relative_day_dates, relative_month_dates, spread_dates
from seedview.operators.keys import dense_id_map, file_row_ids, number_by_range, rekey_database, scan_row_ids
from seedview.operators.sample import sample_rows
from seedview.operators.splits import assign_split, element_at_fraction, fractional_split, indexed_split
from seedview.operators.views import build_view, preview
from seedview.sources.problems import timestamp, toy_churn


def test_dense_ids_of_numbers_and_text(spark, skew_mode):
    numbers = frame(spark, [(v,) for v in (30, -5, 30, None, 12)], "v bigint")
    assert {r.old_id: r.new_id for r in dense_id_map(numbers, "v").collect()} == {-5: 0, 12: 1, 30: 2}
    text = frame(spark, [(v,) for v in ("b", "a", None, "c", "a")], "v string")
    assert {r.old_id: r.new_id for r in dense_id_map(text, "v").collect()} == {"a": 0, "b": 1, "c": 2}


def test_numbering_by_range_is_dense_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v"))
    numbered = number_by_range(rows, ["v"], "i").orderBy("v").collect()
    assert [r.i for r in numbered] == list(range(1000))


def test_file_row_ids_over_several_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = file_row_ids(spark.read.parquet(str(tmp_path / "t")), "row_id").collect()
    assert sorted(r.row_id for r in rows) == list(range(100))
    assert sorted(r.id for r in rows) == list(range(100))


def test_scan_row_ids_are_dense(spark, tmp_path):
    spark.range(50).repartition(4).write.csv(str(tmp_path / "c"), header=True)
    df = spark.read.csv(str(tmp_path / "c"), header=True)
    out = scan_row_ids(df, "row_id")
    assert out.columns == ["id", "row_id"]
    assert sorted(r.row_id for r in out.collect()) == list(range(50))


def test_scan_row_ids_follow_the_files_not_the_planner(spark, tmp_path):
    """Files of very different size, cut into splits that the planner orders by size."""
    bounds = [(0, 3), (3, 1500), (1500, 1510), (1510, 4000)]
    for n, (low, high) in enumerate(bounds):
        lines = "".join(f"{i},{'x' * (i % 50)}\n" for i in range(low, high))
        (tmp_path / f"f{n}.csv").write_text("id,pad\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.schema("id bigint, pad string").csv(str(tmp_path), header=True)
        assert scan.rdd.getNumPartitions() > 4
        out = scan_row_ids(scan, "row_id")
        assert all(r.row_id == r.id for r in out.collect()) and out.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbering_by_range_needs_one_exchange(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("v"))
    plan = number_by_range(rows, ["v"], "i")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0] and "hashpartitioning(__part" not in plan.split("BroadcastExchange")[0]
    assert [r.i for r in number_by_range(rows, ["v"], "i").orderBy("v").collect()] == list(range(1000))


def test_small_samples_read_once_and_large_ones_agree(spark, tmp_path, monkeypatch):
    from seedview.operators import sample

    spark.range(3000).withColumn("x", F.col("id") * 2).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    small = sample_rows(df, 70, ["id"], seed=5)
    assert small._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    monkeypatch.setattr(sample, "MOST_MERGED", 0)
    large = sample_rows(df, 70, ["id"], seed=5)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} and small.columns == large.columns


def test_rekeyed_database(spark):
    db, _ = toy_churn(spark)
    rekeyed, maps = rekey_database(db)
    users = {r.user_id for r in rekeyed.table("users").df.collect()}
    assert users == set(range(5)) and set(maps) == {"users", "transactions"}
    old = {r.tx_id: r.user_id for r in db.table("transactions").df.collect()}
    new = {r.tx_id + 1: r.user_id + 1 for r in rekeyed.table("transactions").df.collect()}
    assert old == new


def test_fixed_split_may_leave_validation_empty(spark):
    _, task = toy_churn(spark)
    cut = [timestamp(datetime(2024, 3, d)) for d in (1, 10)]
    counts = {r["split"]: r["count"] for r in assign_split(task.task_table, "seed_time", *cut).groupBy("split").count().collect()}
    assert counts == {"train": 5, "test": 5}


def test_rows_without_time_get_no_split(spark):
    df = frame(spark, [(1, None)], "id bigint, t string", ["t"])
    assert assign_split(df, "t", timestamp(datetime(2024, 1, 1)), timestamp(datetime(2024, 2, 1))).first()["split"] is None


def test_fractional_split_keeps_ties_together(spark, skew_mode):
    df = frame(spark, [(i, f"2024-01-{d:02d}") for i, d in enumerate([1] * 6 + [2] * 3 + [3])], "id bigint, t string", ["t"])
    out = fractional_split(df, "t")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    # index int(.7 * 10) = 7 -> day 2; int(.85 * 10) = 8 -> day 2: validation is empty
    assert counts == {"train": 6, "test": 4}
    cut = element_at_fraction(df, "t", {"half": 0.5, "late": 0.95}).first()
    assert (cut.half.day, cut.late.day) == (1, 3)


def test_indexed_split_may_repeat_rows(spark):
    rows = frame(spark, [(0, "a"), (1, "b")], "row_id bigint, v string")
    index = frame(spark, [(0, "train"), (0, "test")], "row_id bigint, split string")
    assert sorted((r.v, r["split"]) for r in indexed_split(rows, index).collect()) == [("a", "test"), ("a", "train")]


def test_dates_are_spread_over_the_window(spark, skew_mode):
    df = frame(spark, [(i * 3,) for i in range(20)], "k bigint")
    out = [r.d for r in spread_dates(df, "k", "d").orderBy("k").collect()]
    assert out[0] == datetime(2015, 6, 1) and out[-1] == datetime(2016, 9, 30) and out == sorted(out)
    single = spread_dates(df.limit(1), "k", "d", date(2020, 1, 1), date(2020, 12, 31)).first()
    assert single.d == datetime(2020, 1, 1)


def test_relative_dates(spark):
    dates = frame(spark, [(1, "2016-01-31")], "k bigint, d string", ["d"])
    child = frame(spark, [(1, 1, -1.9), (2, 1, None), (3, 2, -1.0), (4, None, -1.0)], "id bigint, k bigint, off double")
    days = {r.id: r.at for r in relative_day_dates(child, "k", "off", "at", dates).collect()}
    assert days == {1: datetime(2016, 1, 30), 2: None, 3: None, 4: None}
    months = {r.id: r.at for r in relative_month_dates(child, "k", "off", "at", dates).collect()}
    assert months[1] == datetime(2015, 12, 5)  # int(-1.9 * 30) = -57 days


def test_sample_is_exact_and_ignores_partitioning(spark, skew_mode):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    one = {r.id for r in sample_rows(df, 50, ["id"], seed=3).collect()}
    two = {r.id for r in sample_rows(df.repartition(7), 50, ["id"], seed=3).collect()}
    other = {r.id for r in sample_rows(df, 50, ["id"], seed=4).collect()}
    assert len(one) == 50 and one == two and one != other
    assert sample_rows(df, 9999, ["id"]).count() == 500 and sample_rows(df, None, ["id"]).count() == 500


def test_future_signal_is_a_week_ahead_in_nanoseconds(spark):
    df = frame(spark, [("1970-01-02", 1), ("1970-01-02", None)], "seed_time string, label int", ["seed_time"])
    signals = [r.future_leak_signal for r in audit.future_signal(df, "seed_time", "label").collect()]
    assert signals == [8 * 86400 * 10**9, None]


def test_each_seed_is_audited_against_its_own_past(spark):
    """The toy's seeds are two; a leak of what comes after is found at each, also through a parent."""
    db, task = toy_churn(spark)
    seeds = sorted({r.seed_time for r in task.task_table.collect()})

    def safe(d, t):
        return build_view(d, t, ViewConfig("jt_temporalagg", lookback_days=30))

    clean = {r.seed: (r.n_instances, r.n_changed) for r in audit.audit_each_seed(db, task, safe).collect()}
    assert clean == {s: (5, 0) for s in seeds}

    def leaks(d, t):
        table = d.table("transactions")
        counts = table.df.groupBy(F.col(table.foreign_key_to("users")).alias(t.entity_key)).agg(F.count("*").alias("n_ever"))
        return safe(d, t).join(counts, t.entity_key, "left")

    later = [
        sum(1 for u in range(1, 6) if any(r.user_id == u and r[db.table("transactions").time_col] > s for r in rows))
        for rows in [db.table("transactions").df.collect()]
        for s in seeds
    ]
    found = {r.seed: r.n_changed for r in audit.audit_each_seed(db, task, leaks).collect()}
    assert found == dict(zip(seeds, later)) and max(later) > 0
    one = audit.audit_each_seed(db, task, leaks, seeds[:1]).collect()
    assert [(r.seed, r.n_changed) for r in one] == [(seeds[0], later[0])]
    with pytest.raises(ValueError, match="more than"):
        audit.audit_each_seed(db, task, safe, [seeds[0]] * 300)


def test_audit_passes_views_and_catches_a_leak(spark):
    db, task = toy_churn(spark)
    cutoff = timestamp(datetime(2024, 2, 20))

    def safe(d, t):
        return build_view(d, t, ViewConfig("jt_temporalagg", lookback_days=30))

    def leaky(d, t):
        totals = d.table("transactions").df.groupBy("user_id").agg(F.count("*").alias("n_ever"))
        return t.task_table.join(totals, "user_id", "left")

    assert tuple(audit.leakage_audit(db, task, cutoff, safe).first()) == (5, 0)
    assert audit.leakage_audit(db, task, cutoff, leaky).first().n_changed == 5


def test_late_rows_are_counted(spark):
    df = frame(spark, [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-02")], "t string, s string", ["t", "s"])
    assert tuple(audit.rows_after_seed(df, "t", "s").first()) == (2, 1)


def test_relational_summary(spark):
    db, task = toy_churn(spark)
    found = {(r.kind, r.name): r.n_rows for r in audit.relational_summary(db, task).collect()}
    assert found == {("table", "users"): 5, ("table", "transactions"): 15, ("split", "all"): 10}


def test_preview_of_one_split(spark):
    _, task = toy_churn(spark)
    rows = assign_split(task.task_table, "seed_time", timestamp(datetime(2024, 3, 1)), timestamp(datetime(2024, 3, 10)))
    assert preview(rows).count() == 10 and preview(rows, "test").count() == 5 and preview(rows, "test", 2).count() == 2


def test_copies_of_the_audit_count_no_keys_as_categories(spark):
    db, task = toy_churn(spark)
    built = []

    def build(d, t):
        built.append(d)
        return build_view(d, t, ViewConfig("jt_temporalagg", lookback_days=30))

    assert {r.n_changed for r in audit.audit_each_seed(db, task, build).collect()} == {0}
    copy = built[1].table("transactions")
    assert copy.primary_key == "tx_id" and "__tx_id" not in copy.df.columns
    assert built[1].table("users").primary_key == "__user_id"
