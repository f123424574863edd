"""Scores, representation invariance and preprocessing."""

import math
import random

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from seedview.functions import invariance, scores
from seedview.operators import prep
from seedview.operators import running as running_module
from seedview.plans.models import score_batches

NAN, INF = float("nan"), float("inf")


def test_missing_scores_are_counted_and_not_scored(spark):
    rows = [("a", 0.9, 1), ("a", None, 0), ("a", float("nan"), 1), ("b", 0.9, 1), ("b", 0.1, 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r.g: (r.n_pos, r.n_neg, r.n_missing, r.auroc) for r in scores.auroc(df, "score", "label", ["g"]).collect()}
    assert got == {"a": (1, 0, 2, None), "b": (1, 1, 0, 1.0), "c": (0, 0, 1, None)}
    errors = {r.g: (r.n, r.n_missing, r.mae is None) for r in scores.mae(df, "score", "label", ["g"]).collect()}
    assert errors == {"a": (1, 2, True), "b": (2, 0, False), "c": (0, 1, True)}


def test_scorer_leaves_other_columns_alone(spark):
    rows = [(9007199254740993, 1.0, "9000-01-01 00:00:00"), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "id bigint, x double, at string")
    df = df.withColumn("at", df["at"].cast("timestamp_ntz"))
    out = score_batches(df, lambda frame: frame["x"] * 2, ["x"])
    assert out.drop("prediction").exceptAll(df).isEmpty() and sorted(r.prediction for r in out.select("prediction").collect()) == [2, 4]


def pairwise_auroc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_counts_ties_half(spark, skew_mode):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 4, rng.randrange(2)) for _ in range(150)]
    df = frame(spark, rows, "score double, label int")
    out = scores.auroc(df, "score", "label").first()
    assert out.auroc == pytest.approx(pairwise_auroc(rows), abs=1e-12)
    assert (out.n_pos, out.n_neg) == (sum(y for _, y in rows), sum(1 - y for _, y in rows))


def test_auroc_by_group_and_one_class(spark, skew_mode):
    rows = [("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.5, 1), ("b", 0.6, 1), ("c", 0.3, 1), ("c", 0.7, 0)]
    df = frame(spark, rows, "g string, score double, label int")
    assert {r.g: r.auroc for r in scores.auroc(df, "score", "label", ["g"]).collect()} == {"a": 1.0, "b": None, "c": 0.0}


def test_mae_and_utility(spark):
    df = frame(spark, [(1.0, 3.0), (5.0, 4.0)], "label double, p double")
    assert scores.mae(df, "p", "label").first().mae == 1.5
    assert scores.evaluate(df, "p", "label", "mae").first().metric_value == 1.5
    with pytest.raises(ValueError):
        scores.evaluate(df, "p", "label", "rmse")
    runs = frame(spark, [(0.7, "auroc"), (2.0, "mae"), (0.0, "mae")], "v double, m string")
    got = [r.u for r in runs.select(scores.utility(F.col("v"), F.col("m")).alias("u")).collect()]
    assert got == [0.7, pytest.approx(-math.log(2)), pytest.approx(-math.log(1e-12))]


def ris_of(spark, values, metric):
    rows = [("t", metric, f"r{i}", float(v)) for i, v in enumerate(values)]
    return invariance.ris_by_task(
        frame(spark, rows, "task_name string, metric_name string, representation string, metric_value double")
    ).first()


@pytest.mark.parametrize(
    "values, metric, ris, low, high",
    [
        ([0.7, 0.7, 0.7], "auroc", 1.0, 1.0, 1.0),
        ([0.5, 0.8], "auroc", 0.5, 0.0, 1.0),
        ([10.0, 2.0], "mae", 0.5, 0.0, 1.0),
        ([3.0, 3.0], "mae", 1.0, 1.0, 1.0),
        ([0.75], "auroc", 1.0, 1.0, 1.0),
        ([0.5, 0.5], "auroc", 1.0, 0.0, 0.0),
    ],
)
def test_ris(spark, values, metric, ris, low, high):
    row = ris_of(spark, values, metric)
    assert (row.ris, row.utility_min, row.utility_max) == (pytest.approx(ris), pytest.approx(low), pytest.approx(high))


def test_ris_of_the_published_scores(spark):
    """With a constant predictor among the views, and without two settings that are one."""
    row = ris_of(spark, [0.469142, 0.682405, 0.669726, 0.5], "auroc")
    assert row.utility_std == pytest.approx(0.528884, abs=1e-6) and row.utility_gap == pytest.approx(1.169173, abs=1e-6)
    sweep = [0.611400, 0.682405, 0.732056, 0.802284, 0.469142, 0.576381, 0.669726, 0.669726]
    assert ris_of(spark, sweep, "auroc").ris == pytest.approx(0.687582, abs=1e-6)


def test_all_below_chance_exceeds_one(spark):
    row = ris_of(spark, [0.4, 0.3], "auroc")
    assert (row.utility_min, row.utility_max) == (pytest.approx(1.0), pytest.approx(2.0))


def test_macro_ris(spark):
    per_task = frame(spark, [("a", 0.8), ("b", 0.6)], "task_name string, ris double")
    row = invariance.macro_ris(per_task).first()
    assert (row.macro_ris, row.macro_ris_std, row.n_tasks) == (pytest.approx(0.7), pytest.approx(0.1), 2)
    empty = invariance.macro_ris(per_task.where("false")).first()
    assert math.isnan(empty.macro_ris) and math.isnan(empty.macro_ris_std) and empty.n_tasks == 0


def test_best_per_representation(spark):
    rows = [("t", "auroc", "x", 0.6), ("t", "auroc", "x", 0.8), ("u", "mae", "x", 2.0), ("u", "mae", "x", 1.0)]
    df = frame(spark, rows, "task_name string, metric_name string, representation string, metric_value double")
    assert {r.task_name: r.metric_value for r in invariance.best_per_representation(df).collect()} == {"t": 0.8, "u": 1.0}


def test_median_is_exact_and_skips_bad_values(spark, skew_mode):
    rows = [(1.0, 5), (2.0, None), (3.0, 7), (4.0, None), (NAN, None), (INF, None), (None, None)]
    df = frame(spark, rows, "a double, b int")
    found = {r.c: (r.n, r.median) for r in prep.medians(df, ["a", "b"]).collect()}
    assert found == {"a": (4, 2.5), "b": (2, 6.0)}


def test_median_of_random_values(spark, skew_mode):
    rng = random.Random(5)
    values = [round(rng.gauss(0, 3), 1) for _ in range(301)]
    df = frame(spark, [(v,) for v in values], "v double")
    assert prep.medians(df, ["v"]).first().median == pytest.approx(float(np.median(values)))


def test_scale_is_population_and_never_zero(spark):
    df = frame(spark, [(1.0, 4.0), (2.0, 4.0), (3.0, None)], "a double, b double")
    found = {r.c: (r.mean, r["std"]) for r in prep.scale_stats(df, ["a", "b"], {"a": 2.0, "b": 4.0}).collect()}
    assert found["a"] == (2.0, pytest.approx(math.sqrt(2 / 3))) and found["b"] == (4.0, 1.0)


def test_mode_prefers_the_smallest_of_equals(spark):
    df = frame(spark, [("b", "x"), ("a", "x"), ("b", "y"), ("a", None), (None, "y")], "k string, l string")
    assert {r.c: (r["mode"], r.n) for r in prep.modes(df, ["k", "l"]).collect()} == {"k": ("a", 2), "l": ("x", 2)}


def test_nonfinite_values_get_the_training_median(spark):
    train = frame(spark, [(1.0, None), (5.0, None)], "a double, b double")
    df = frame(spark, [(NAN, INF), (None, 2.0), (-INF, None), (9.0, None)], "a double, b double")
    out = prep.impute_nonfinite(df, ["a", "b"], train).collect()
    assert [tuple(r) for r in out] == [(3.0, 0.0), (3.0, 2.0), (3.0, 0.0), (9.0, 0.0)]


def test_one_hot_codes_leave_unseen_values_out(spark):
    train = frame(spark, [("b",), ("a",), ("b",)], "k string")
    df = frame(spark, [("a",), ("b",), ("z",), (None,)], "k string")
    assert {r.k: r.k__code for r in prep.one_hot_codes(df, "k", train).collect()} == {"a": 0, "b": 1, "z": None, None: None}


def test_class_weight(spark):
    df = frame(spark, [(1,), (0,), (0,), (0,)], "label int")
    assert tuple(prep.class_weight(df, "label").first()) == (1, 3, 3.0)
    assert prep.class_weight(df.where("label = 0"), "label").first().pos_weight == 1.0


def test_preprocessing_fits_on_train_only(spark):
    train = frame(spark, [(1.0, "a", 0), (None, "b", 1), (3.0, "b", 0)], "x double, k string, label int")
    test = frame(spark, [(100.0, "zzz", 1), (None, None, 0)], "x double, k string, label int")
    fitted = prep.TabularPrep("label").fit(train)
    # median 2 -> values 1, 2, 3: mean 2, population std sqrt(2/3)
    rows = [r.features.toArray().tolist() for r in fitted.transform(test).collect()]
    assert rows[0] == [pytest.approx(98 / math.sqrt(2 / 3)), 0.0, 0.0]
    assert rows[1] == [0.0, 0.0, 1.0]  # missing number -> median, missing category -> mode "b"
    with pytest.raises(RuntimeError):
        prep.TabularPrep("label").transform(test)


def test_more_categories_than_a_driver_table_would_hold(spark):
    train = spark.range(120_000).selectExpr("concat('name', id) AS name", "cast(id % 2 AS double) AS label")
    fitted = prep.TabularPrep("label").fit(train)
    assert fitted.n_positions == 120_000
    vector = fitted.transform(train.where("name = 'name99999'")).first().features
    assert vector.size == 120_000 and vector.numNonzeros() == 1
    assert fitted.transform(train.limit(1).selectExpr("'unseen' AS name", "label")).first().features.numNonzeros() == 0


def test_auroc_probes_the_counts_and_not_their_source(spark, monkeypatch):
    spark.conf.set("seedview.skew", "always")
    read = []
    monkeypatch.setattr(running_module, "hot_groups", lambda rows, by, skew: read.extend(rows.inputFiles()))
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.1, 1)], "score double, label int")
    assert scores.auroc(df, "score", "label").first().auroc == 0.75
    assert read
