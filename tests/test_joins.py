"""As-of joins, lookups, parents and neighbourhoods."""

from datetime import datetime

import pytest
from helpers import frame, history_frames, problem, random_history
from pyspark.sql import functions as F

from seedview.model import DatabaseSpec, TableSpec, TaskSpec, ViewConfig
from seedview.operators import neighbors
from seedview.operators.asof import asof_join
from seedview.operators.degrees import incident_counts, incident_table_cap, incident_tables
from seedview.operators.lookup import duplicate_keys, lookup, remap_foreign_key, static_lookup
from seedview.operators.neighbors import edge_types, neighbor_edges, neighbor_nodes, node_types
from seedview.operators.reach import reachable_tables
from seedview.operators.views import build_view, entity_view, graph_view
from seedview.session import SkewPolicy
from seedview.sources.problems import toy_churn


def test_asof_takes_the_latest_row_for_interleaved_keys(spark, skew_mode):
    left = frame(
        spark,
        [(1, "2024-03-20", 1), (2, "2024-02-10", 0), (1, "2024-02-10", 0), (2, "2024-03-20", 1)],
        "user_id bigint, seed_time string, label int",
        ["seed_time"],
    )
    right = frame(
        spark,
        [(1, "2024-01-01", 10), (1, "2024-03-01", 11), (2, "2024-01-15", 20), (2, "2024-02-20", 21)],
        "user_id bigint, updated_at string, age int",
        ["updated_at"],
    )
    out = asof_join(
        left, right, left_key="user_id", left_time="seed_time", right_key="user_id", right_time="updated_at", prefix="users__"
    )
    assert out.columns == ["user_id", "seed_time", "label", "users__age"]
    found = {(r.user_id, r.seed_time.month): r.users__age for r in out.collect()}
    assert found == {(1, 3): 11, (2, 2): 20, (1, 2): 10, (2, 3): 21}


def test_asof_random_with_ties_and_missing_times(spark, skew_mode):
    children, seeds = random_history(11)
    child, instances = history_frames(spark, children, seeds)
    instances = instances.unionByName(frame(spark, [(1, None)], "user_id bigint, seed_time string", ["seed_time"]))
    out = asof_join(
        instances, child, left_key="user_id", left_time="seed_time", right_key="user_id", right_time="t", tie="tx_id"
    ).collect()
    assert len(out) == len(seeds) + 1
    for row in out:
        past = [c for c in children if c[1] == row.user_id and c[2] and row.seed_time and c[2] <= row.seed_time]
        best = max(past, key=lambda c: (c[2], c[0]), default=None)
        assert row.tx_id == (best[0] if best else None)
        assert row.x == (best[3] if best else None)


def test_lookup_keeps_unmatched_and_null_keys(spark, skew_mode):
    left = frame(spark, [(i, 7 if i < 30 else i % 5) for i in range(40)] + [(99, None)], "id bigint, k bigint")
    right = frame(spark, [(7, "hot"), (1, "one")], "k bigint, name string")
    found = {r.id: r.name for r in lookup(left, right, ["k"]).collect()}
    assert len(found) == 41 and found[3] == "hot" and found[31] == "one" and found[32] is None and found[99] is None
    named = static_lookup(left, "k", right, "k", "p__")
    assert named.columns == ["id", "k", "p__name"] and named.count() == 41


def test_remap_makes_dangling_keys_null(spark, skew_mode):
    df = frame(spark, [(1, 10), (2, 20), (3, None), (4, 99)], "id bigint, fk bigint")
    id_map = frame(spark, [(10, 0), (20, 1)], "old_id bigint, new_id bigint")
    out = remap_foreign_key(df, "fk", id_map)
    assert out.columns == ["id", "fk"]
    assert {r.id: r.fk for r in out.collect()} == {1: 0, 2: 1, 3: None, 4: None}


def test_duplicate_keys(spark):
    df = frame(spark, [(1,), (1,), (2,)], "k bigint")
    assert [(r.k, r.n_rows) for r in duplicate_keys(df, "k").collect()] == [(1, 2)]


def chain(spark):
    """users -> city -> country; a user's city is a foreign key of the users table."""
    country = frame(spark, [(100, "NL"), (200, "DE")], "country_id bigint, name string")
    city = frame(spark, [(10, "Delft", 100), (20, "Bonn", 200)], "city_id bigint, name string, country_id bigint")
    users = frame(spark, [(1, 10), (2, 20), (3, None)], "user_id bigint, city_id bigint")
    rows = frame(
        spark, [(1, "2024-01-01", 1), (2, "2024-01-01", 0), (3, "2024-01-01", 1), (1, "2024-01-01", 1)],
        "user_id bigint, seed_time string, label int", ["seed_time"],
    )
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id", None, {"city_id": "city"}),
            "city": TableSpec("city", city, "city_id", None, {"country_id": "country"}),
            "country": TableSpec("country", country, "country_id"),
        }
    )
    return db, TaskSpec("t", "classification", "label", "auroc", "users", "user_id", "seed_time", rows)


def test_parents_follow_the_hops(spark, skew_mode):
    db, task = chain(spark)
    one = entity_view(db, task, ViewConfig("jt_entity", max_path_hops=1))
    two = entity_view(db, task, ViewConfig("jt_entity", max_path_hops=2))
    none = entity_view(db, task, ViewConfig("jt_entity", include_parent_lookups=False))
    assert none.columns == ["user_id", "seed_time", "label", "users__city_id"]
    assert one.columns == none.columns + ["city__name", "city__country_id"]
    assert two.columns == one.columns + ["country__name"]
    found = sorted((r.user_id, r.city__name or "", r.country__name or "") for r in two.collect())
    assert found == [(1, "Delft", "NL"), (1, "Delft", "NL"), (2, "Bonn", "DE"), (3, "", "")]


def test_reachable_tables(spark):
    db, _ = chain(spark)
    assert list(reachable_tables(db, "users", 1)) == ["users", "city"]
    assert reachable_tables(db, "users", 2)["country"] == [("users", "city_id", "city"), ("city", "country_id", "country")]
    assert set(reachable_tables(db, "country", 2)) == {"country", "city", "users"}


def test_metadata_is_checked(spark):
    df = frame(spark, [(1,)], "k bigint")
    with pytest.raises(KeyError):
        TableSpec("t", df, "nope")
    with pytest.raises(KeyError):
        DatabaseSpec({"t": TableSpec("t", df, "k", None, {"k": "other"})})
    with pytest.raises(ValueError):
        ViewConfig("jt_other")
    with pytest.raises(ValueError):
        ViewConfig("jt_entity", aggregation_functions=("median",))


def test_temporal_view_keeps_every_task_row(spark, skew_mode):
    db, task = toy_churn(spark)
    doubled = task.with_table(task.task_table.unionByName(task.task_table))
    view = build_view(db, doubled, ViewConfig("jt_temporalagg", lookback_days=30))
    assert view.count() == 20
    assert "users__country" in view.columns and "transactions__amount__mean" in view.columns
    assert view.where("transactions__row_count is null").isEmpty()


def test_incident_counts(spark, skew_mode):
    db, task = toy_churn(spark)
    frame_ = incident_counts(db, task)
    assert frame_.columns == ["user_id", "seed_time", "label", "graphdeg__transactions__count_leq_seed"]
    history = db.table("transactions").df.collect()
    for row in frame_.collect():
        want = sum(t.user_id == row.user_id and t.event_time <= row.seed_time for t in history)
        assert row.graphdeg__transactions__count_leq_seed == want
    with pytest.raises(KeyError):
        incident_counts(db, task, task.task_table.drop("label"))


def test_incident_counts_ignore_undated_rows(spark, skew_mode):
    children, seeds = random_history(13)
    child, instances = history_frames(spark, children, seeds)
    db, task = problem(spark, [(1,)], "user_id bigint", child, instances)
    for row in incident_counts(db, task).collect():
        want = sum(c[1] == row.user_id and c[2] is not None and c[2] <= row.seed_time for c in children)
        assert row.graphdeg__tx__count_leq_seed == want


def test_table_cap(spark):
    assert [incident_table_cap(k, 3) for k in (None, 1, 100, 250, 900)] == [None, 1, 1, 2, 3]
    db, task = toy_churn(spark)
    assert [t.name for t, _ in incident_tables(db, "users")] == ["transactions"]
    assert graph_view(db, task, 100).columns[-1] == "graphdeg__transactions__count_leq_seed"


@pytest.mark.parametrize("k, carried", [(1, 64), (3, 64), (3, 0), (None, 64)])
def test_neighbors(spark, skew_mode, monkeypatch, k, carried):
    """Carried along by the seeds or fetched by number, in blocks if all are asked for."""
    monkeypatch.setattr(neighbors, "MOST_CARRIED", carried)
    monkeypatch.setattr(neighbors, "BLOCK", 4)
    children, seeds = random_history(17, n_rows=60)
    child, instances = history_frames(spark, children, seeds)
    db, task = problem(spark, [(1, 0.5), (2, None)], "user_id bigint, score double", child, instances)
    nodes = neighbor_nodes(db, task, k).collect()
    roots = {(r.user_id, r.seed_time): r for r in nodes if r.node_type == "users"}
    assert set(roots) == set(seeds) and all(r.node_idx == 0 for r in roots.values())
    assert next(r.features for key, r in roots.items() if key[0] == 1) == [1.0, 0.5]
    assert next(r.features for key, r in roots.items() if key[0] == 5) == [0.0, 0.0]
    events = {}
    for r in nodes:
        if r.node_type == "tx":
            events.setdefault((r.user_id, r.seed_time), {})[r.node_idx] = r.features[0]
    for user, seed in set(seeds):
        past = sorted((c[2], c[0]) for c in children if c[1] == user and c[2] and c[2] <= seed)
        want = [float(i) for _, i in (past if k is None else past[-k:])]
        assert [v for _, v in sorted(events.get((user, seed), {}).items())] == want


def test_edges_come_in_both_directions(spark):
    db, task = toy_churn(spark)
    assert node_types(db, task) == ["users", "transactions"]
    assert edge_types(db, task) == [("users", "has_transactions", "transactions"), ("transactions", "in_users", "users")]
    nodes = neighbor_nodes(db, task, 1)
    edges = neighbor_edges(nodes, task)
    n_events = nodes.where("node_type = 'transactions'").count()
    assert n_events <= 10 and edges.count() == 2 * n_events
    assert edges.where("relation = 'has_transactions' and src_idx <> 0").isEmpty()


def test_two_foreign_keys_give_two_relations(spark):
    users = frame(spark, [(1,), (2,)], "user_id bigint")
    moves = frame(
        spark, [(1, 1, 2, "2024-01-01"), (2, 2, 1, "2024-01-02")], "id bigint, src bigint, dst bigint, t string", ["t"]
    )
    rows = frame(spark, [(1, "2024-02-01", 1)], "user_id bigint, seed_time string, label int", ["seed_time"])
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id"),
            "moves": TableSpec("moves", moves, "id", "t", {"src": "users", "dst": "users"}),
        }
    )
    task = TaskSpec("t", "classification", "label", "auroc", "users", "user_id", "seed_time", rows)
    assert node_types(db, task) == ["users", "moves_src", "moves_dst"]
    assert sorted(r.node_type for r in neighbor_nodes(db, task, 5).collect()) == ["moves_dst", "moves_src", "users"]


@pytest.mark.parametrize("k", [0, 1, 2, None])
def test_static_neighbors_are_the_first_by_key(spark, skew_mode, monkeypatch, k):
    """User 1 has a third of all cards; text keys are in text order."""
    monkeypatch.setattr(neighbors, "BLOCK", 3)
    owner = [1 if i % 3 == 0 else [2, 3, None, 9][i % 4] for i in range(40)]
    users = frame(spark, [(i,) for i in (1, 2, 3, 4)], "user_id bigint")
    cards = frame(spark, [(f"c{i}", user, float(i)) for i, user in enumerate(owner)], "id string, user_id bigint, x double")
    seeds = [(1, "2024-02-01", 1), (1, "2024-03-01", 0), (2, "2024-02-01", 1), (3, "2024-02-01", 1), (4, "2024-02-01", 1)]
    rows = frame(spark, seeds, "user_id bigint, seed_time string, label int", ["seed_time"])
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id"),
            "cards": TableSpec("cards", cards, "id", None, {"user_id": "users"}),
        }
    )
    task = TaskSpec("t", "classification", "label", "auroc", "users", "user_id", "seed_time", rows)
    found = {}
    for r in neighbor_nodes(db, task, k).where("node_type = 'cards'").collect():
        found.setdefault((r.user_id, r.seed_time.month), {})[r.node_idx] = r.features[1]
    for user, day, _ in seeds:
        want = [float(i) for _, i in sorted((f"c{i}", i) for i, o in enumerate(owner) if o == user)][:k]
        assert [v for _, v in sorted(found.pop((user, int(day[5:7])), {}).items())] == want
    assert not found


def test_static_neighbors_are_limited_before_the_shuffle(spark):
    db, task = problem(spark, [(1, 0.5)], "user_id bigint, score double", *history_frames(spark, *random_history(3)))
    child = db.table("tx")
    db = DatabaseSpec({**db.tables, "tx": TableSpec("tx", child.df, "tx_id", None, child.foreign_keys)})
    plan = neighbor_nodes(db, task, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dated_neighbors_read_the_child_once(spark, tmp_path):
    child, instances = history_frames(spark, *random_history(3))
    child.write.parquet(str(tmp_path / "tx"))
    db, task = problem(spark, [(1, 0.5)], "user_id bigint, score double", spark.read.parquet(str(tmp_path / "tx")), instances)
    plan = neighbor_nodes(db, task, 3).where("node_type = 'tx'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_two_cards(spark):
    users = frame(spark, [(1,)], "user_id bigint")
    cards = frame(spark, [(i, 1) for i in (5, 3, 9)], "id bigint, user_id bigint")
    rows = frame(spark, [(1, "2024-02-01", 1)], "user_id bigint, seed_time string, label int", ["seed_time"])
    db = DatabaseSpec(
        {
            "users": TableSpec("users", users, "user_id"),
            "cards": TableSpec("cards", cards, "id", None, {"user_id": "users"}),
        }
    )
    task = TaskSpec("t", "classification", "label", "auroc", "users", "user_id", "seed_time", rows)
    found = neighbor_nodes(db, task, 2).where("node_type = 'cards'").orderBy("node_idx").collect()
    assert [r.features[0] for r in found] == [3.0, 5.0]


def test_dated_entity_node_is_its_row_as_of_the_seed(spark):
    child = frame(spark, [], "tx_id bigint, user_id bigint, t string", ["t"])
    instances = frame(spark, [(1, "2024-02-01")], "user_id bigint, seed_time string", ["seed_time"])
    versions = [(1, 10.0, datetime(2024, 1, 1)), (1, 20.0, datetime(2024, 3, 1))]
    db, task = problem(spark, versions, "user_id bigint, age double, since string", child, instances, "since")
    assert neighbor_nodes(db, task, 5).where(F.col("node_type") == "users").first().features == [1.0, 10.0]


def doubled(spark):
    return frame(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "x"), (None, "y")], "id bigint, name string")


def test_a_lookup_refuses_a_key_that_occurs_twice(spark, skew_mode):
    left = frame(spark, [(k, i) for i, k in enumerate([1, 1, 1, 3, None])], "k bigint, i int")
    with pytest.raises(Exception, match="p__id: key 2 occurs 2 times"):
        static_lookup(left, "k", doubled(spark), "id", "p__").collect()
    clean = doubled(spark).where("name <> 'c'")
    found = {(r.i, r.p__name) for r in static_lookup(left, "k", clean, "id", "p__").collect()}
    assert found == {(0, "a"), (1, "a"), (2, "a"), (3, None), (4, None)}


def test_the_guard_adds_no_exchange_to_a_sorted_join(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    both = [spark.read.parquet(str(tmp_path / "t")) for _ in range(2)]
    count = {}
    for guard in (None, "t"):
        joined = lookup(both[0].select("id"), both[1], ["id"], guard=guard)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        count[guard] = (plan.count("Exchange"), plan.count("Sort "), plan.count("FileScan"))
    assert count[None] == count["t"]


def test_a_view_refuses_a_parent_that_occurs_twice(spark, tmp_path):
    """The registered query on tables whose nations repeat."""
    from pathlib import Path

    source = Path("/root/testdata/sf0.001")
    if not source.is_dir():
        pytest.skip("test tables are not there")
    for path in source.glob("*.parquet"):
        if path.stem != "nation":
            (tmp_path / path.name).symlink_to(path)
    nation = spark.read.parquet(str(source / "nation.parquet"))
    nation.union(nation.where("n_nationkey = 7")).write.parquet(str(tmp_path / "nation.parquet"))
    from seedview.plans.queries import QUERIES

    with pytest.raises(Exception, match="n_nationkey: key 7 occurs 2 times"):
        QUERIES["parent_lookup_2hop"](spark, str(tmp_path)).collect()


def test_neighbors_of_small_keys_are_not_limited_first(spark, monkeypatch):
    """The window over equal instants is for hot keys; the probe that finds none must not wait for it."""
    db, task = problem(spark, [(1, 0.5)], "user_id bigint, score double", *history_frames(spark, *random_history(3)))
    probed = []
    found_hot = neighbors.hot_groups
    monkeypatch.setattr(neighbors, "hot_groups", lambda rows, by, skew: probed.append(rows) or found_hot(rows, by, skew))
    policy = SkewPolicy(active=True, min_rows=1_000_000, fair=1, slices=4, grid=0, parts=7)
    nodes = neighbor_nodes(db, task, 3, skew=policy).where("node_type = 'tx'")
    assert len(probed) == 1 and "Window" not in probed[0]._jdf.queryExecution().optimizedPlan().toString()
    assert ", 7)" in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, nodes.collect())) == sorted(map(str, neighbor_nodes(db, task, 3).where("node_type = 'tx'").collect()))
