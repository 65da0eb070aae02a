"""Tuning with failures, row limits of the modes, tables saved with the model."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluate as ev
from flowlens.operators.oneclass import fit_one_class, fit_standard, top_results, tune
from flowlens.plans import training


@pytest.fixture(scope="module")
def labelled(spark):
    """1,200 benign rows around the origin, 300 attacks far from it."""
    u = [(F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2 ** 32)
         for s in "abc"]
    attack = F.col("id") >= 1200
    df = spark.range(1500).select(
        "id", *[(u[k] + F.when(attack, 6.0 + k).otherwise(0.0)).alias(c) for k, c in enumerate(("x", "y", "z"))],
        F.when(attack, "DDoS").otherwise("BENIGN").alias("label"),
        F.md5(F.col("id").cast("string")).alias("row_hash"))
    return df.persist()


def test_a_failing_combination_leaves_the_others(spark, labelled):
    train = labelled.filter("label = 'BENIGN'")
    validation = labelled.withColumn("Attack", (F.col("label") != "BENIGN").cast("int"))
    grid = spark.createDataFrame([(0, 0.1, "1e200", "poly"), (1, 0.1, "scale", "rbf"), (2, 0.3, "scale", "rbf")],
                                 "idx int, nu double, gamma string, kernel string")
    kw = dict(n_landmarks=16, iterations=4)
    res, best = tune(train, validation, ["x", "y", "z"], grid, **kw)
    rows = {r["idx"]: r for r in res.collect()}
    assert "not finite" in rows[0]["error"] and rows[0]["f1_score"] is None
    scaler = fit_standard(train, ["x", "y", "z"])
    for i, nu in ((1, 0.1), (2, 0.3)):               # one pass over all models = each model on its own
        m = fit_one_class(train, ["x", "y", "z"], "rbf", "scale", nu, scaler=scaler, **kw)
        scored = m.transform(validation).withColumn("yhat", F.col("is_anomaly").cast("int"))
        want = ev.metrics_from_confusion(ev.confusion(scored)).collect()[0]
        assert all(rows[i][k] == pytest.approx(want[k], abs=1e-12) for k in ("accuracy", "precision", "recall", "f1_score"))
        assert rows[i]["error"] is None and rows[i]["fit_seconds"] > 0 and rows[i]["n_train"] == 1200
        assert 0 < rows[i]["support_ratio"] <= 16 / 1200
    assert best["nu"] == 0.1 and [r["idx"] for r in top_results(res).collect()] == [1, 2, 0]
    res, best = tune(train, validation, ["x", "y", "z"], grid.filter("idx = 0"), **kw)
    assert best is None and res.count() == 1


def test_run_is_saved_and_loaded(spark, labelled, tmp_path):
    grid = spark.createDataFrame([(0, 0.2, "scale", "rbf"), (1, 0.05, "scale", "rbf")],
                                 "idx int, nu double, gamma string, kernel string")
    run = training.run_training(labelled, ["x", "y", "z"], mode="hyperparam", keep=("id",), n_landmarks=16, iterations=4,
                                out_dir=str(tmp_path / "model"), grid=grid)
    got = training.load_training(spark, str(tmp_path / "model"))
    assert got.model.rho == run.model.rho and got.model.nu == run.model.nu
    for name in training.SAVED_TABLES:
        assert sorted(map(str, getattr(got, name).collect())) == sorted(map(str, getattr(run, name).collect()))
    s = got.summary.collect()[0]
    assert s["n_combinations"] == 2 and s["n_test_sets"] == 1 and s["nu"] in (0.2, 0.05)
    sizes = json.loads(s["test_sizes"])
    assert sizes["overall"] + s["n_train"] == 1500
    training.run_training(labelled, ["x", "y", "z"], mode="full", keep=("id",), n_landmarks=8, iterations=1,
                          out_dir=str(tmp_path / "plain"))
    assert training.load_training(spark, str(tmp_path / "plain")).tuning is None


def test_rows_of_a_mode(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(training.MODES, "small", dict(training.MODES["small"], rows_per_file=40, target_rows=100))
    files = []
    for i, encoding in enumerate(("utf-8", "latin-1", "utf-8", "utf-8")):
        (tmp_path / f"{i}.csv").write_bytes(("A,Label\n" + "".join(f"{k},é{i}\n" for k in range(60))).encode(encoding))
        files.append(str(tmp_path / f"{i}.csv"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rows = training.read_for_mode(spark, files, "small").collect()
        assert len(rows) == 100 and {r["Label"] for r in rows} == {"é0", "é1", "é2"} and max(r["A"] for r in rows) < 40
        assert training.read_for_mode(spark, files, "full").count() == 240


def test_rows_are_cleaned_and_scored_once(spark, labelled, monkeypatch):
    """The input is read once, to store its rows; cleaning reads those; splits, fit and scores read the clean ones."""
    stored, real = [], training.materialize
    monkeypatch.setattr(training, "materialize", lambda df, *a: stored.append(real(df, *a)) or stored[-1])
    scored, transform = [], training.OneClassModel.transform
    monkeypatch.setattr(training.OneClassModel, "transform", lambda self, df: scored.append(df) or transform(self, df))
    rows = labelled.withColumn("f0", F.lit(1.0) * F.col("id"))
    run = training.run_training(rows, ["x", "y", "z"], mode="hyperparam", profile="paper", keep=("id", "f0"), n_landmarks=8, iterations=1)
    first, clean = stored
    assert set(first.columns) == {"label", "row_hash", "x", "y", "z"} and set(clean.columns) == {*first.columns, "Attack"}
    assert len(scored) == 1 and set(scored[0].inputFiles()) == set(clean.inputFiles())
    s = run.summary.collect()[0]
    sizes = json.loads(s["test_sizes"])
    assert sizes["overall"] + s["n_train"] == 1500
    assert "Scan" not in run.metrics._jdf.queryExecution().toString().replace("LocalTableScan", "").replace("Scan ExistingRDD", "")
    m = run.metrics.collect()[0]
    assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == sizes["overall"] and "n" not in run.metrics.columns
