"""One-class model properties (G8): outlier share near nu, separable data, persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluate as ev
from flowlens.operators.oneclass import OneClassModel, fit_one_class, kernel_matrix
from flowlens.operators.split import row_hash


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.RandomState(0)
    normal = rng.normal(0, 1, size=(3000, 2))
    attack = rng.normal(6, 0.5, size=(3000, 2))
    rows = [(i, float(x), float(y), 0) for i, (x, y) in enumerate(normal)] + \
           [(3000 + i, float(x), float(y), 1) for i, (x, y) in enumerate(attack)]
    return spark.createDataFrame(rows, "id long, a double, b double, Attack int").withColumn("row_hash", row_hash(["id"]))


def test_outlier_share_near_nu(spark, toy):
    train = toy.filter("Attack = 0")
    m = fit_one_class(train, ["a", "b"], "rbf", "scale", 0.1, n_landmarks=64, iterations=30)
    share = m.transform(train).agg(F.avg(F.col("is_anomaly").cast("double"))).collect()[0][0]
    assert abs(share - 0.1) <= 0.02


def test_separable_f1(spark, toy):
    m = fit_one_class(toy.filter("Attack = 0"), ["a", "b"], "rbf", "scale", 0.05, n_landmarks=64, iterations=30)
    scored = m.transform(toy).withColumn("yhat", F.col("is_anomaly").cast("int"))
    f1 = ev.evaluate(scored).collect()[0]["f1_score"]
    assert f1 > 0.95


def test_landmark_order_invariance():
    rng = np.random.RandomState(1)
    L, X, a = rng.normal(size=(10, 3)), rng.normal(size=(5, 3)), rng.normal(size=10)
    p = rng.permutation(10)
    s1 = kernel_matrix(X, L, "rbf", 0.5) @ a
    s2 = kernel_matrix(X, L[p], "rbf", 0.5) @ a[p]
    assert np.allclose(s1, s2)


def test_save_load_roundtrip(spark, toy, tmp_path):
    m = fit_one_class(toy.filter("Attack = 0"), ["a", "b"], "rbf", 0.5, 0.1, n_landmarks=16, iterations=5)
    m.save(spark, str(tmp_path / "model"))
    m2 = OneClassModel.load(spark, str(tmp_path / "model"))
    s1 = [r["score"] for r in m.transform(toy).orderBy("id").collect()]
    s2 = [r["score"] for r in m2.transform(toy).orderBy("id").collect()]
    assert np.allclose(s1, s2)
    assert m2.describe(spark).count() == 1


def test_scores_with_more_vectors_than_one_block(spark):
    from flowlens.operators.oneclass import model_from_table
    from flowlens.operators.scale import Scaler
    rng = np.random.RandomState(3)
    x, alpha = rng.normal(size=(5000, 2)), rng.rand(5000) / 5000
    table = spark.createDataFrame([(i, [float(v) for v in x[i]], float(alpha[i])) for i in range(5000)],
                                  "sv_id int, x array<double>, alpha double")
    m = model_from_table(table, Scaler(["a", "b"], [0.0, 0.0], [1.0, 1.0], "standard"), ["a", "b"], rho=0.1, gamma=0.5)
    rows = [(0.0, 0.0), (1.5, -2.0), (9.0, 9.0)]
    got = [r["score"] for r in m.transform(spark.createDataFrame(rows, "a double, b double")).collect()]
    assert np.allclose(got, kernel_matrix(np.array(rows), x, "rbf", 0.5, 3, 0.0) @ alpha - 0.1)


def test_rho_of_the_iterations_is_from_all_rows(spark, toy, monkeypatch):
    from flowlens.operators import oneclass
    asked = []
    real = oneclass.seeded_sample
    monkeypatch.setattr(oneclass, "seeded_sample", lambda df, n, *a: asked.append(n) or real(df, n, *a))
    fit_one_class(toy.filter("Attack = 0"), ["a", "b"], "rbf", "scale", 0.1, n_landmarks=16, iterations=2)
    assert asked == [16]                                    # the landmarks only


def test_fallback_only_for_numeric_failures(spark, toy, monkeypatch):
    from flowlens.operators import oneclass
    train = toy.filter("Attack = 0")
    real, seen = oneclass.fit_one_class, []

    def fails(error):
        def fit(df, features, **kw):
            seen.append(df.count())
            if len(seen) == 1:
                raise error
            return real(df, features, n_landmarks=8, iterations=1)
        return fit

    monkeypatch.setattr(oneclass, "fit_one_class", fails(oneclass.FitFailure("not finite")))
    with pytest.warns(UserWarning, match="not finite"):
        model = oneclass.fit_with_fallback(train, ["a", "b"], 500)
    assert seen == [3000, 500] and model.params["fallback_used"] is True
    seen.clear()
    monkeypatch.setattr(oneclass, "fit_one_class", fails(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        oneclass.fit_with_fallback(train, ["a", "b"], 500)
    with pytest.raises(oneclass.FitFailure):
        real(train.withColumn("a", toy.a * float("inf")), ["a", "b"], n_landmarks=8, iterations=1)


@pytest.mark.parametrize("ties", [False, True])
def test_fit_equals_brute_force(spark, ties):
    import math
    rng = np.random.RandomState(7)
    x = rng.normal(size=(4000, 2)).round(0 if ties else 12)
    train = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double") \
        .withColumn("row_hash", row_hash(["id"])).repartition(3)
    m = fit_one_class(train, ["a", "b"], "rbf", "scale", 0.1, n_landmarks=12, iterations=6, tol=0.0)
    z = (x - np.array(m.scaler.center)) / np.array(m.scaler.scale)
    lam, u = np.linalg.eigh(kernel_matrix(m.landmarks, m.landmarks, "rbf", m.gamma))
    phi = kernel_matrix(z, m.landmarks, "rbf", m.gamma) @ (u[:, lam > 1e-10] / np.sqrt(lam[lam > 1e-10]))
    w = phi.mean(0)
    for t in range(7):
        s = phi @ w
        rho = np.sort(s)[math.ceil(400) - 1]
        if t < 6:
            eta = 2.0 / (t + 2.0)
            w = (1.0 - eta) * w + eta * phi[s < rho - 1e-10].sum(0) / 400
    assert m.rho == pytest.approx(rho, abs=1e-9)
    assert np.allclose(kernel_matrix(z, m.landmarks, "rbf", m.gamma) @ m.coef, phi @ w, atol=1e-9)


def test_rank_is_found_without_good_pivots(spark, monkeypatch):
    """Pivots that say nothing about the scores cost passes, not rows: all rows are counted, whatever the pivots are."""
    from flowlens.operators import oneclass
    rng = np.random.RandomState(8)
    rows = [(i, float(v)) for i, v in enumerate(rng.normal(size=3000) * 10.0 ** rng.randint(-8, 2, 3000))]
    train = spark.createDataFrame(rows, "id long, a double").withColumn("row_hash", row_hash(["id"])).repartition(4)
    kw = dict(n_landmarks=8, iterations=2, tol=0.0)
    want = fit_one_class(train, ["a"], "rbf", "scale", 0.2, **kw)
    passes, real = [], oneclass._bins
    monkeypatch.setattr(oneclass, "_bins", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(oneclass, "_edges_near", lambda *a: np.array([1e300]))
    got = fit_one_class(train, ["a"], "rbf", "scale", 0.2, **kw)
    assert got.rho == pytest.approx(want.rho, abs=1e-12) and np.allclose(got.coef, want.coef, rtol=1e-6)
    assert 4 < len(passes) <= 1 + 3 * 11


def test_fit_keeps_no_feature_map_and_evens_out_its_rows(spark, monkeypatch):
    """What is kept is the training columns, once and over all slots; formerly r columns of phi for each row too."""
    from flowlens.operators import oneclass
    monkeypatch.setattr(oneclass, "SPREAD_ROWS", 1000)
    frame, kept = type(spark.range(0)), []
    real = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: kept.append(self) or real(self, *a))
    rows = spark.range(0, 5000, 1, 1).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    train = rows.withColumn("row_hash", row_hash(["id"]))
    m = fit_one_class(train, ["a", "b"], "rbf", "scale", 0.1, n_landmarks=16, iterations=2)
    assert m.params["n_train"] == 5000
    assert all(set(k.columns) == {"row_hash", "a", "b"} for k in kept)
    assert kept[-1].rdd.getNumPartitions() > 1 and not any(k.is_cached for k in kept)
