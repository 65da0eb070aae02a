"""Training run (E-3): clean -> split -> sample -> fit -> evaluate -> save.

Each step is a distributed job; the driver only sequences them and holds bounded results
(fitted scaler, m landmarks, one confusion row per test set).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import clean, evaluate as ev, split
from flowlens.operators.oneclass import OneClassModel, fit_with_fallback, tune
from flowlens.sources.io import materialize
from flowlens.sources.labelled import read_labelled_with_fallback

# ---------------------------------------------------------------------------
# The reference's sample-size modes (total rows, rows per file, benign
# training rows, reduced-sample fallback size) and the model parameters of each mode.
# ---------------------------------------------------------------------------
MODES = {
    "small": {"target_rows": 100_000, "rows_per_file": 20_000, "benign_rows": 50_000, "fallback_rows": 5_000,
              "params": {"kernel": "rbf", "gamma": "scale", "nu": 0.1}},
    "medium": {"target_rows": 500_000, "rows_per_file": 80_000, "benign_rows": 200_000, "fallback_rows": 20_000,
               "params": {"kernel": "sigmoid", "gamma": 1.0, "nu": 0.1}},
    "large": {"target_rows": 1_000_000, "rows_per_file": 160_000, "benign_rows": 400_000, "fallback_rows": 30_000,
              "params": {"kernel": "rbf", "gamma": "scale", "nu": 0.04}},
    "hyperparam": {"target_rows": 20_000, "rows_per_file": 5_000, "benign_rows": 10_000, "fallback_rows": 1_000,
                   "params": {"kernel": "rbf", "gamma": "scale", "nu": 0.05}},
    "full": {"target_rows": None, "rows_per_file": None, "benign_rows": None, "fallback_rows": 50_000,
             "params": {"kernel": "rbf", "gamma": "scale", "nu": 0.05}},
}


FILE_ROWS = 500_000    # of the stored clean rows
SAVED_TABLES = ("metrics", "summary", "tuning")    # beside the model's own tables in its directory


@dataclass
class TrainingRun:
    model: OneClassModel
    metrics: DataFrame      # one row per test set (G14-G17, G20)
    summary: DataFrame      # G22 one-row record
    tuning: DataFrame | None = None     # G13 results, one row per combination


def modes_table(spark) -> DataFrame:
    """G21 as a table of configuration rows."""
    rows = [(m, c["target_rows"], c["rows_per_file"], c["benign_rows"], c["fallback_rows"], json.dumps(c["params"]))
            for m, c in MODES.items()]
    return spark.createDataFrame(rows, "mode string, target_rows bigint, rows_per_file bigint, benign_rows bigint, "
                                       "fallback_rows bigint, params string")


def read_for_mode(spark, files: list[str], mode: str, label: str = "Label", **kw) -> DataFrame:
    """Labelled files under the row limits of ``mode``: the first ``rows_per_file`` rows of each file until
    ``target_rows`` are reached, then a seeded sample of that many. Encodings are decided file by file (A6)."""
    cfg = MODES[mode]
    return read_labelled_with_fallback(spark, files, rows_per_file=cfg["rows_per_file"], target_rows=cfg["target_rows"],
                                       label=label, sample=True, **kw)


def load_training(spark, path: str) -> TrainingRun:
    """The model of a directory with the tables that its run saved beside it."""
    tables = {}
    for name in SAVED_TABLES:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or name != "tuning":     # only a tuned run has that one
                raise
    return TrainingRun(OneClassModel.load(spark, path), tables["metrics"], tables["summary"], tables.get("tuning"))


def run_training(labelled: DataFrame, features: list[str] | None = None, mode: str = "small", profile: str = "default",
                 label: str = "label", keep: tuple[str, ...] = (), hash_col: str = "row_hash",
                 n_landmarks: int = 256, iterations: int = 30, out_dir: str | None = None,
                 params: dict | None = None, grid: DataFrame | None = None) -> TrainingRun:
    """One training run. With ``grid`` (``param_grid``) every combination is fitted first and the best one's values
    replace those of the mode (G13). With ``out_dir`` the model, the metrics of each test set, the summary and the
    tuning results are saved there (A9, G22) and come back by ``load_training``."""
    cfg = MODES[mode]
    p = dict(cfg["params"], **(params or {}))
    t0 = time.time()
    # Stored before and after cleaning, in files of bounded rows: cleaning passes over the first several times, splits, fits
    # and scores over the second, and neither computes again what the rows are made of. Kept columns play no part in a run.
    rows = clean.strip_column_names(labelled)
    rows = materialize(rows.drop(*(set(keep) - {label, hash_col, *(features or ())})), "labelled", FILE_ROWS)
    df = clean.clean_labelled(rows, label=label, profile=profile, mode=mode, keep=(*keep, hash_col))
    feats = features or clean.feature_columns(df, (label, "Attack", *keep, hash_col))
    df = materialize(df.select(*dict.fromkeys((label, "Attack", hash_col, *feats))), "clean", FILE_ROWS)
    if profile == "paper":
        sets = split.paper_split(df, label, hash_col=hash_col)
    else:
        sets = split.benign_split(df, label, hash_col=hash_col).withColumn(
            "test_set", F.when(F.col("part") == "train", "train").otherwise("overall")).drop("part")
    train = sets.filter(F.col("test_set") == "train")
    if cfg["benign_rows"]:
        train = split.seeded_sample(train, cfg["benign_rows"], hash_col)
    test = sets.filter(F.col("test_set") != "train")
    tuning = None
    if grid is not None:
        # "overall" holds every test row; the paper profile's other sets are parts of it
        tuning, best = tune(train, test.filter(F.col("test_set") == "overall"), feats, grid, n_landmarks=n_landmarks,
                            iterations=iterations, hash_col=hash_col)
        p.update(best or {})
    fit_kw = dict(kernel=p["kernel"], gamma=p["gamma"], nu=p["nu"], n_landmarks=n_landmarks,
                  iterations=iterations, hash_col=hash_col)
    model = fit_with_fallback(train, feats, cfg["fallback_rows"], **fit_kw)    # G9
    n_train_used = model.params.get("n_train")
    fit_s = time.time() - t0
    scored = model.transform(test).withColumn("yhat", F.col("is_anomaly").cast("int"))
    cm = ev.confusion(scored, "Attack", "yhat", by=["test_set"], rows="n")
    spark = labelled.sparkSession
    cm = spark.createDataFrame(cm.collect(), cm.schema)        # one row per test set: the test rows are scored once
    metrics = ev.detection_rates(ev.metrics_from_confusion(cm.drop("n")))
    m_rows = {r["test_set"]: r.asDict() for r in metrics.collect()}
    model.metrics = {k: {m: v[m] for m in ("accuracy", "precision", "recall", "f1_score")} for k, v in m_rows.items()}
    sizes = {r["test_set"]: r["n"] for r in cm.collect()}
    ov = m_rows.get("overall", {})
    summary = spark.createDataFrame(
        [(mode, profile, p["kernel"], str(p["gamma"]), float(p["nu"]), float(model.gamma), len(feats),
          int(n_train_used or 0), int(len(model.coef)), float(model.rho), ov.get("accuracy"), ov.get("precision"),
          ov.get("recall"), ov.get("f1_score"), round(fit_s, 3), json.dumps(model.metrics),
          model.params["fallback_used"], json.dumps(dict(sorted(sizes.items()))), len(m_rows),
          None if tuning is None else tuning.count())],
        "mode string, profile string, kernel string, gamma string, nu double, gamma_value double, n_features int, "
        "n_train bigint, n_landmarks int, rho double, accuracy double, precision double, recall double, "
        "f1_score double, train_seconds double, metrics_by_set string, fallback_used boolean, test_sizes string, "
        "n_test_sets int, n_combinations bigint")
    run = TrainingRun(model, metrics, summary, tuning)
    if out_dir:
        model.save(spark, out_dir)
        for name in SAVED_TABLES:
            table = getattr(run, name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return run
