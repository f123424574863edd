"""Loaders, sinks, models and protocols end to end."""

import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from helpers import frame
from pyspark.sql import functions as F

from seedview.operators.splits import assign_split
from seedview.plans import models, protocol
from seedview.plans.models import PREDICTION, CallbackModel, ConstantModel, SparkTabularModel
from seedview.model import TaskSpec, ViewConfig, metric_for
from seedview.sources import blocks, sinks, sweeps, tables
from seedview.sources.csvdb import CREDIT, CsvTable, load_csv_problem, read_csv
from seedview.sources.problems import timestamp, toy_churn


def write_csv(path, header, rows):
    text = [",".join(header)] + [",".join("" if v is None else str(v) for v in row) for row in rows]
    path.write_text("\n".join(text) + "\n")


@pytest.fixture()
def credit_files(tmp_path):
    rng = random.Random(0)
    ids = [100 + 7 * i for i in range(20)]
    write_csv(
        tmp_path / "application_train.csv",
        ["SK_ID_CURR", "TARGET", "AMT_CREDIT", "NAME_CONTRACT_TYPE"],
        [(k, i % 2, 1000.5 + i, "Cash") for i, k in enumerate(ids)],
    )
    write_csv(
        tmp_path / "bureau.csv",
        ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_ACTIVE"],
        [(k, 5000 + i, -rng.randrange(1, 400), "Active") for i, k in enumerate(ids)],
    )
    write_csv(
        tmp_path / "bureau_balance.csv",
        ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"],
        [(5000 + i % 20, -(i // 20), "C") for i in range(60)],
    )
    write_csv(
        tmp_path / "previous_application.csv",
        ["SK_ID_CURR", "SK_ID_PREV", "DAYS_DECISION", "AMT_APPLICATION"],
        [(ids[i], 9000 + i, -10 * (i + 1), 5.5) for i in range(16)],
    )
    for name, n in (("POS_CASH_balance.csv", 32), ("credit_card_balance.csv", 16)):
        write_csv(
            tmp_path / name,
            ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "SK_DPD"],
            [(ids[i % 16], 9000 + i % 16, -(i // 16) - 1, 0) for i in range(n)],
        )
    write_csv(
        tmp_path / "installments_payments.csv",
        ["SK_ID_CURR", "SK_ID_PREV", "DAYS_INSTALMENT", "AMT_PAYMENT"],
        [(ids[i % 16], 9000 + i % 16, None if i == 0 else -float(i), 1.5) for i in range(48)],
    )
    return tmp_path


def test_credit_database(spark, credit_files):
    db, task = load_csv_problem(spark, str(credit_files), CREDIT)
    assert list(db.tables) == list(CREDIT.tables) and len(db.tables) == 7
    assert "TARGET" not in db.table("application").df.columns
    assert db.table("bureau_balance").time_col is None
    assert db.table("pos_cash_balance").foreign_keys == {"SK_ID_CURR": "application", "SK_ID_PREV": "previous_application"}
    rows = task.task_table.orderBy("SK_ID_CURR").collect()
    dates = [r.APPLICATION_DATE for r in rows]
    assert dates == sorted(dates) and dates[0] == datetime(2015, 6, 1) and dates[-1] == datetime(2016, 9, 30)
    assert [r["split"] for r in rows] == ["train"] * 14 + ["val"] * 3 + ["test"] * 3
    parents = {r.SK_ID_CURR: r.APPLICATION_DATE for r in rows}
    for name, key in (("bureau", "SK_ID_BUREAU"), ("installments_payments", "_inst_row_id"), ("pos_cash_balance", "_pos_row_id")):
        table = db.table(name)
        found = table.df.collect()
        assert all(r[table.time_col] is None or r[table.time_col] <= parents[r.SK_ID_CURR] for r in found)
        assert len({r[key] for r in found}) == len(found)
    assert db.table("installments_payments").df.where("INSTALL_DATE is null").count() == 1
    assert sorted(r._bb_row_id for r in db.table("bureau_balance").df.collect()) == list(range(60))


def test_missing_csv_file(spark, credit_files):
    (credit_files / "bureau.csv").unlink()
    with pytest.raises(FileNotFoundError, match="bureau.csv"):
        load_csv_problem(spark, str(credit_files), CREDIT)


def declared(**schemas):
    """The credit layout with declared schemas for some tables."""
    return replace(CREDIT, tables={n: replace(t, schema=schemas[n], infer=False) if n in schemas else t for n, t in CREDIT.tables.items()})


def test_bad_lines_fail_the_load_or_are_kept_apart(spark, credit_files):
    path = credit_files / "bureau_balance.csv"
    path.write_text(path.read_text().replace("5003,0,C", "5003,zero,C") + "5001,-7\n5002,-8,C,extra\n")
    problem = declared(bureau_balance="SK_ID_BUREAU bigint, MONTHS_BALANCE bigint, STATUS string")
    with pytest.raises(Exception, match="[Mm]alformed"):
        load_csv_problem(spark, str(credit_files), problem)[0].table("bureau_balance").df.collect()
    bad = {}
    db, _ = load_csv_problem(spark, str(credit_files), problem, bad)
    rows = db.table("bureau_balance").df.collect()
    assert sorted(r._bb_row_id for r in rows) == sorted({*range(60)} - {3}) and "_corrupt_record" not in db.table("bureau_balance").df.columns
    assert sorted((r.line, r.text) for r in bad["bureau_balance"].collect()) == [(3, "5003,zero,C"), (60, "5001,-7"), (61, "5002,-8,C,extra")]
    assert set(bad) == set(CREDIT.tables) and bad["bureau"].count() == 0


def test_schemas_are_declared_or_asked_for(spark, credit_files):
    with pytest.raises(ValueError, match="declare a schema"):
        read_csv(spark, str(credit_files / "bureau.csv"), CsvTable("bureau.csv"))
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(credit_files / "bureau_balance.csv"), CsvTable("b", "a bigint, b bigint, c string"))[0].collect()
    table, _ = read_csv(spark, str(credit_files / "bureau.csv"), CsvTable("bureau.csv", "SK_ID_BUREAU string", infer=True))
    assert dict(table.dtypes) == {"SK_ID_CURR": "bigint", "SK_ID_BUREAU": "string", "DAYS_CREDIT": "bigint", "CREDIT_ACTIVE": "string"}


def test_unlabelled_entities_are_left_out(spark, credit_files):
    path = credit_files / "application_train.csv"
    path.write_text(path.read_text() + "999,,1.0,Cash\n")
    db, task = load_csv_problem(spark, str(credit_files), CREDIT)
    assert task.task_table.count() == 20 and db.table("application").df.count() == 20


def test_blocks_without_key_are_aligned_by_position(spark, tmp_path):
    rows = [(i, i * 37 % 11) for i in range(200)]
    for files, name in enumerate(("num", "bin", "cat"), 1):
        df = frame(spark, [(i, v) for i, v in rows], f"row_id bigint, {name}0 bigint")
        blocks.write_block(df, ["row_id"], str(tmp_path / f"X_{name}.parquet"), 3 * files)
    read = blocks.read_blocks(spark, str(tmp_path), include_meta=True)
    assert set(read) == {"num", "bin", "cat"}
    found = read["num"].join(read["bin"], "row_id").join(read["cat"], "row_id").collect()
    assert sorted((r.row_id, r.num0, r.bin0, r.cat0) for r in found) == [(i, v, v, v) for i, v in rows]
    frame(spark, [(1, 2)], "row_id bigint, m bigint").drop("row_id").write.parquet(str(tmp_path / "X_meta.parquet"))
    with pytest.raises(ValueError, match="differ in their number of rows"):
        blocks.read_blocks(spark, str(tmp_path), include_meta=True)


def test_split_files_name_their_split(spark, tmp_path):
    for part, ids in (("train", [0, 1]), ("val", [2])):
        frame(spark, [(i,) for i in ids], "row_id bigint").write.parquet(str(tmp_path / f"split-late/{part}_idx.parquet"))
    with pytest.raises(FileNotFoundError, match="split 'late' lacks test_idx.parquet"):
        blocks.read_split_index(spark, str(tmp_path))
    frame(spark, [(5,)], "row_id bigint").write.parquet(str(tmp_path / "split-late/test_idx.parquet"))
    rows = blocks.read_split_index(spark, str(tmp_path)).collect()
    assert sorted((r.split_name, r.split, r.row_id) for r in rows) == [
        ("late", "test", 5), ("late", "train", 0), ("late", "train", 1), ("late", "val", 2)
    ]
    assert blocks.available_folders(spark, str(tmp_path)) == ["late"]


def test_blocks(spark, tmp_path):
    rows = range(12)
    frames = {
        "num": frame(spark, [(i, i / 2, i * 1.0) for i in rows], "row_id bigint, n0 double, n1 double"),
        "bin": frame(spark, [(i, i % 2) for i in rows], "row_id bigint, b0 int"),
        "cat": frame(spark, [(i, i % 3) for i in rows], "row_id bigint, c0 bigint"),
        "meta": frame(spark, [(i, i, -i) for i in rows], "row_id bigint, m0 bigint, m1 bigint"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"X_{name}.parquet"))
    labels = frame(spark, [(i, i % 2) for i in rows], "row_id bigint, label int")
    part = lambda i: "train" if i < 6 else "val" if i < 9 else "test"
    index = frame(spark, [("default", part(i), i) for i in rows], "split_name string, split string, row_id bigint")
    plain = blocks.read_blocks(spark, str(tmp_path))
    meta = blocks.read_blocks(spark, str(tmp_path), include_meta=True)
    assert blocks.block_features(plain) == ["n0", "n1", "b0", "c0"]
    assert blocks.block_features(meta) == ["n0", "n1", "b0", "c0", "m0", "m1"]
    wide = blocks.assemble_blocks(meta, labels, index, "default")
    assert wide.columns == ["row_id", "label", "split", "n0", "n1", "b0", "c0", "m0", "m1"]
    assert {t for n, t in wide.dtypes if n in blocks.block_features(meta)} == {"float"}
    from seedview.operators.audit import split_summary

    found = {r["split"]: (r.n_rows, r.positive_rate) for r in split_summary(wide, "label").collect()}
    assert found == {"train": (6, 0.5), "val": (3, pytest.approx(1 / 3)), "test": (3, pytest.approx(2 / 3))}
    assert [r.split_name for r in blocks.available_splits(index).collect()] == ["default"]
    with pytest.raises(FileNotFoundError):
        blocks.check_blocks({"num": frames["num"]})


def test_sweep_results(spark, tmp_path):
    def document(split, auroc):
        return {"split": split, "n_features": 4, "n_rows": {"train": 6, "val": 3, "test": 3},
                "metrics": None if auroc is None else {"val_auroc": 0.5, "test_auroc": auroc}}

    for name, doc in {"t1": document("s", 0.6), "t2": document("s", 0.8), "t3": document("o", 0.7), "t4": document("o", None)}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "unfinished").mkdir()
    assert sweeps.folders_without_result(spark, str(tmp_path)) == ["unfinished"]
    rows = sweeps.read_sweep_results(spark, str(tmp_path))
    assert sorted(r.task for r in rows.collect()) == ["t1", "t2", "t3", "t4"]
    assert rows.where("task = 't1'").first().n_train == 6
    found = {r["split"]: (r.n_runs, r.mean_test, r.std_test) for r in sweeps.summarize_sweep(rows).collect()}
    assert found == {"s": (2, pytest.approx(0.7), pytest.approx(0.02**0.5)), "o": (1, 0.7, 0.0)}
    sinks.write_csv(rows, str(tmp_path / "summary"))
    assert spark.read.csv(str(tmp_path / "summary"), header=True).count() == 4


def split_toy(spark):
    db, task = toy_churn(spark)
    cut = [timestamp(datetime(2024, 3, d)) for d in (1, 10)]
    return db, task.with_table(assign_split(task.task_table, "seed_time", *cut))


def test_export_is_complete_and_skipped_the_second_time(spark, tmp_path):
    db, task = split_toy(spark)
    assert sinks.export_relational(spark, db, task, str(tmp_path))
    assert not sinks.export_relational(spark, db, task, str(tmp_path))
    assert sinks.export_relational(spark, db, task, str(tmp_path), force=True)
    assert spark.read.parquet(str(tmp_path / "db/users.parquet")).count() == 5
    sizes = {s: spark.read.parquet(str(tmp_path / f"tasks/toy_churn/{s}.parquet")).count() for s in tables.SPLITS}
    assert sizes == {"train": 5, "val": 0, "test": 5}
    loaded = tables.load_split_task(
        spark, str(tmp_path / "tasks/toy_churn"), name="t", task_type="classification", target_col="label",
        entity_table="users", entity_key="user_id", seed_time_col="seed_time",
    )
    assert loaded.metric_name == "auroc" and loaded.task_table.where("split = 'test'").count() == 5


def test_tasks_are_validated(spark):
    assert (metric_for("classification"), metric_for("regression")) == ("auroc", "mae")
    with pytest.raises(ValueError):
        metric_for("ranking")
    _, task = toy_churn(spark)
    bad = task.with_table(task.task_table.withColumn("label", F.lit(2)))
    tables.validate_task(task)
    with pytest.raises(ValueError):
        tables.validate_task(bad)
    with pytest.raises(KeyError):
        task.with_table(task.task_table.drop("label"))


def test_protocols_with_constant_models(spark, tmp_path):
    db, task = split_toy(spark)
    constant = ConstantModel
    a = protocol.run_protocol_a(db, task, [constant("c-jt")], [constant("c-rel")], [constant("c-graph")], output_dir=str(tmp_path))
    b = protocol.run_protocol_b(
        db, task, [constant("c-jt")], lambda k: [constant("c-graph")],
        configs=[ViewConfig("jt_temporalagg", lookback_days=7)], k_values=[100], output_dir=str(tmp_path),
    )
    assert a.runs.count() == 4 and b.runs.count() == 2
    assert a.ris.first().n_representations == 4 and b.ris.first().n_representations == 2
    assert all(r.metric_value == 0.5 for r in a.runs.collect())
    for name in ("protocol_a__runs.parquet", "protocol_a__ris.json", "protocol_b__runs.parquet", "protocol_b__ris.json"):
        assert (tmp_path / f"toy_churn__{name}").exists()
    flat = spark.read.parquet(str(tmp_path / "toy_churn__protocol_a__runs.parquet"))
    assert {"compute__wall_clock_sec", "extra__subview", "utility_value"} <= set(flat.columns)


def test_keys_of_different_views_never_meet(spark):
    configs = list(protocol.PROTOCOL_B_VIEWS)
    assert len(configs) == 6 and [c.lookback_days for c in configs[:4]] == [7, 30, 90, None]
    assert (protocol.HOP_SWEEP, protocol.K_SWEEP) == ((1, 2), (100, 300, 500))
    details = {tuple(protocol._joined_details(c).items()) for c in configs}
    assert len(details) == 6


def test_constant_baselines_stay_out_of_ris(spark):
    db, task = split_toy(spark)
    scored = CallbackModel(
        "recency", lambda train, val, t: (None, {}),
        lambda state, data, t: data.withColumn(PREDICTION, -F.coalesce("transactions__row_count", F.lit(0)).cast("double")),
    )
    configs = [ViewConfig("jt_temporalagg", lookback_days=w) for w in (7, None)]
    out = protocol.run_protocol_a(db, task, [scored], [ConstantModel()], configs=configs)
    assert out.runs.count() == 3 and out.ris.first().n_representations == 2


def test_a_given_metric_replaces_prediction(spark):
    class Given:
        name = "external"

        def fit(self, train, val, task):
            return {"precomputed_test_metric": 0.77, "metric_override": 0.1, "backend": "elsewhere"}

        def predict(self, data, task):
            raise AssertionError("not to be called")

    db, task = split_toy(spark)
    out = protocol.run_protocol_a(db, task, [ConstantModel()], [Given()], configs=[ViewConfig("jt_entity")])
    row = out.runs.where("model_name = 'external'").first()
    assert row.metric_value == 0.77 and row.representation == "relational|elsewhere"
    rows = frame(
        spark, [(None, 0.6, 0.5, 0.1), (0.7, 0.6, 0.5, 0.1), (None, None, None, 0.1)],
        "precomputed_test_metric double, precomputed_metric double, metric_override double, metric_value double",
    )
    assert [r.metric_value for r in protocol.override_metric(rows).collect()] == [0.6, 0.7, 0.1]


def separable(spark, n=60):
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=i), i % 2, float(i % 2) + (i % 7) / 10, "ab"[i % 2],
             "train" if i < 30 else "val" if i < 45 else "test") for i in range(n)]
    df = frame(spark, rows, "k bigint, seed_time string, label int, x double, c string, split string", ["seed_time"])
    return df, TaskSpec("sep", "classification", "label", "auroc", "e", "k", "seed_time", df)


def test_boosted_trees_give_probabilities(spark):
    df, task = separable(spark)
    model = SparkTabularModel("gbt", models.boosted_trees("classification", maxIter=3, maxDepth=2), validate=True)
    train, val, test = (df.where(F.col("split") == s) for s in tables.SPLITS)
    model.fit(train, val, task)
    rows = model.predict(test, task).collect()
    assert all(0 <= r.prediction <= 1 for r in rows) and len(rows) == 15
    assert min(r.prediction for r in rows if r.label) > max(r.prediction for r in rows if not r.label)


def test_wide_logistic_regression_spreads_its_coefficients(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from seedview.plans import logistic

    rows = [(k % 23, float((k * 37) % 101), f"c{k % 40}", "big" if k % 3 else f"d{k % 7}", int((k * 13) % 29 > 11)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, name string, kind string, label int").withColumn("t", timestamp(datetime(2020, 1, 1)))
    task = TaskSpec("t", "classification", "label", "auroc", "e", "k", "t", df)
    monkeypatch.setattr(logistic, "BLOCK", 10)
    found = {}
    for most in (1000, 10):
        spark.conf.set("seedview.fit.driverPositions", str(most))
        model = SparkTabularModel("linear", LogisticRegression(maxIter=9))
        model.fit(df, None, task)
        found[most] = [r[PREDICTION] for r in model.predict(df.where("k > 3"), task).orderBy("k", "x", "name", "kind").collect()]
        if most == 1000:
            losses = list(model.fitted.summary.objectiveHistory)
    spark.conf.unset("seedview.fit.driverPositions")
    assert isinstance(model.fitted, logistic.SpreadLogistic)
    assert model.fitted.blocks > 2
    assert model.fitted.losses == pytest.approx(losses, abs=1e-9)
    assert found[10] == pytest.approx(found[1000], abs=1e-7)
    for label in (0, 1):
        spark.conf.set("seedview.fit.driverPositions", "10")
        same = df.withColumn("label", F.lit(label))
        model.fit(same, None, task.with_table(same))
        assert {r[0] for r in model.predict(same, task).select(PREDICTION).distinct().collect()} == {float(label)}
        spark.conf.unset("seedview.fit.driverPositions")


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_wide_boosted_trees_are_those_of_spark(spark, monkeypatch, kind):
    from seedview.plans import boosting

    rng = random.Random(5)
    rows = [(k, rng.randrange(60) * 1.0, round(rng.gauss(0, 1), 1), f"c{rng.randrange(12)}", f"e{rng.randrange(3)}") for k in range(400)]
    score = F.col("x") / 30 + F.col("z") + F.col("c").substr(2, 2).cast("int") % 3 + (F.col("id") * 37 % 11) / 10
    label = (score > 2).cast("int") if kind == "classification" else score
    df = spark.createDataFrame(rows, "id long, x double, z double, c string, e string").withColumn("label", label)
    df = df.withColumn("t", timestamp(datetime(2020, 1, 1)))
    task = TaskSpec("t", kind, "label", metric_for(kind), "e", "id", "t", df)
    monkeypatch.setattr(boosting, "BLOCK", 5)
    settings = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    found = {}
    for most in (1000, 5):
        spark.conf.set("seedview.fit.densePositions", str(most))
        model = SparkTabularModel("gbt", models.boosted_trees(kind, **settings), drop=["id"], validate=True)
        model.fit(df.where("id % 4 < 3"), df.where("id % 4 = 3"), task)
        found[most] = [r[PREDICTION] for r in model.predict(df, task).orderBy("id").collect()]
        grown = model.fitted.getNumTrees if most == 1000 else len(model.fitted.trees)
        assert grown > 1
    spark.conf.unset("seedview.fit.densePositions")
    assert isinstance(model.fitted, boosting.SpreadBoosting)
    assert found[5] == pytest.approx(found[1000], abs=1e-9)


def test_regression_and_row_cap(spark):
    df, task = separable(spark)
    task = TaskSpec("r", "regression", "x", "mae", "e", "k", "seed_time", df)
    model = SparkTabularModel("lin", models.linear_model("regression"), drop=["c"], max_train_rows=20, seed=1)
    model.fit(df, None, task)
    assert model.predict(df, task).where(F.abs(F.col("prediction") - F.col("x")) > 1).isEmpty()


def test_python_scorer_sees_batches(spark):
    df = spark.range(1000).withColumn("v", F.col("id").cast("double"))
    out = models.score_batches(df, lambda pdf: pdf["v"] * 2, ["v"])
    assert out.agg(F.sum("prediction")).first()[0] == 999000.0 and out.columns == ["id", "v", "prediction"]


def test_blocks_of_few_values_are_not_broadcast(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("v"))
    for name in blocks.REQUIRED_BLOCKS:
        rows.withColumnRenamed("v", name).write.parquet(str(tmp_path / f"X_{name}.parquet"))
    rows.withColumnRenamed("v", "label").write.parquet(str(tmp_path / "labels"))
    rows.select(F.lit("s").alias("split_name"), F.lit("train").alias("split"), "row_id").write.parquet(str(tmp_path / "index"))
    labels, index = (spark.read.parquet(str(tmp_path / name)) for name in ("labels", "index"))
    wide = blocks.assemble_blocks(blocks.read_blocks(spark, str(tmp_path)), labels, index, "s")
    assert "Broadcast" not in wide._jdf.queryExecution().executedPlan().toString()
    assert wide.where((F.col("num") == F.col("row_id") % 2) & (F.col("cat") == F.col("label"))).count() == 1000


def test_views_with_the_same_parents_are_written_once(spark, monkeypatch):
    written, write = [], protocol.materialize
    monkeypatch.setattr(protocol, "materialize", lambda view, name: written.append(name) or write(view, name))
    db, task = split_toy(spark)
    constant = ConstantModel
    out = protocol.run_protocol_b(
        db, task, [constant("c-jt")], lambda k: [constant("c-graph")],
        configs=[ViewConfig("jt_temporalagg", lookback_days=7), ViewConfig("jt_entity")], k_values=[100, 300],
    )
    assert out.runs.count() == 4 and sorted(written) == ["entity", "graph"]
