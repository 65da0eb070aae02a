"""One-class kernel model: fit, score, tune, save and describe.

The reference fits libsvm's One-Class SVM on one machine. Here the fit is re-aimed for a
cluster (SURVEY 4.3): m landmarks (seeded, lowest row hashes) give a Nystroem feature map
phi(x) = K(x, L) T, T = U diag(lambda)^-1/2. Phi is never stored: a score is K(x, L) (T w) and a sum of phi is the sum of
kernel rows times T, so a pass computes kernel rows from the cached scaled features, a block of rows at a time, and adds
them up by bins of the score. One pass over all rows gives both the nu-quantile of the scores and the sum over margin violators.
The primal nu-one-class objective
    1/2 |w|^2 - rho + 1/(nu n) sum max(0, rho - w . phi(x))
is minimised by Frank-Wolfe steps w <- (1-eta) w + eta/(nu n) sum_viol phi(x), eta = 2/(t+2),
with rho the nu-quantile of w . phi; the loop stops when the relative duality gap
w . (w - target) / |w|^2 falls below ``tol``. The model is stored as landmarks + coefficients
a = U diag(lambda)^-1/2 w and rho, so scoring is a kernel sum over m landmarks, the same
form as a support-vector sum. Only m x d and m x m arrays, about PIVOTS rows of d features and a pass's bins (at most
EDGES + 1 rows of m sums) ever reach the driver.
"""

from __future__ import annotations

import json
import math
import os
import time
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.quantiles import to_keys, to_value
from flowlens.operators.scale import Scaler, fit_standard, gamma_value
from flowlens.operators.split import seeded_sample

MAX_LANDMARKS = 4096
#: Scoring evaluates the kernel for so many vectors at a time.
SCORE_BLOCK = 1024
#: A pass of the fit computes so many kernel values at a time, and splits the scores at so many places at most.
BLOCK_VALUES = 1 << 17
EDGES = 255
#: About so many training rows tell where the first pass splits the scores. They decide nothing else: every count and sum is over all rows.
PIVOTS = 50_000
#: From so many training rows on, uneven partitions are evened out.
SPREAD_ROWS = 200_000
#: rho's rank is right within this share of the training rows (a ten-thousandth).
RANK_SHARE = 10_000
#: Bound of a stored model that is loaded and broadcast for scoring.
MAX_MODEL_BYTES = 512 * 1024 * 1024

# Reference hyper-parameter grids (kernel, gamma, nu) and defaults.
HYPERPARAM_GRID = {
    "nu": [0.01, 0.05, 0.1, 0.2],
    "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0],
    "kernel": ["rbf", "poly", "sigmoid"],
}
HYPERPARAM_GRID_QUICK = {
    "nu": [0.05, 0.1, 0.2],
    "gamma": ["scale", 0.01, 0.1],
    "kernel": ["rbf"],
}
DEFAULT_PARAMS = {"kernel": "rbf", "gamma": "scale", "nu": 0.05}


def kernel_matrix(X: np.ndarray, L: np.ndarray, kernel: str, gamma: float, degree: int = 3,
                  coef0: float = 0.0) -> np.ndarray:
    """K(X, L) for rbf, poly, sigmoid or linear."""
    if kernel == "rbf":
        d2 = (X * X).sum(1)[:, None] + (L * L).sum(1)[None, :]
        d2 -= 2.0 * (X @ L.T)
        np.maximum(d2, 0.0, out=d2)
        d2 *= -gamma
        return np.exp(d2, out=d2)
    dot = X @ L.T
    if kernel == "poly":
        return (gamma * dot + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if kernel == "linear":
        return dot
    raise ValueError(f"unknown kernel {kernel}")


class FitFailure(ArithmeticError):
    """The fit met numbers that it cannot go on with."""


@dataclass
class OneClassModel:
    features: list[str]
    scaler: Scaler
    landmarks: np.ndarray  # m x d, scaled space
    coef: np.ndarray  # m
    rho: float
    kernel: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 0.0
    nu: float = 0.05
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)

    # -- scoring (G10) ----------------------------------------------------
    def decision_column(self, df: DataFrame, scaled: bool = False) -> Column:
        """f(x) = sum_i a_i K(l_i, x) - rho as an Arrow-batched pandas UDF.

        The model (m x d floats, at most MAX_MODEL_BYTES when loaded from a table) is shipped
        once per executor as a broadcast variable; the kernel is summed over blocks of
        SCORE_BLOCK vectors, so a batch never holds rows x m values."""
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast({
            "L": self.landmarks, "a": self.coef, "rho": self.rho, "kernel": self.kernel, "gamma": self.gamma,
            "degree": self.degree, "coef0": self.coef0,
            "center": np.asarray(self.scaler.center), "scale": np.asarray(self.scaler.scale), "scaled": scaled})

        @F.pandas_udf(T.DoubleType())
        def decision(x: pd.DataFrame) -> pd.Series:
            m = bc.value
            X = x.to_numpy(dtype=np.float64)
            if not m["scaled"]:
                X = (X - m["center"]) / m["scale"]
            f = np.zeros(len(X))
            for i in range(0, len(m["a"]), SCORE_BLOCK):
                K = kernel_matrix(X, m["L"][i:i + SCORE_BLOCK], m["kernel"], m["gamma"], m["degree"], m["coef0"])
                f += K @ m["a"][i:i + SCORE_BLOCK]
            return pd.Series(f - m["rho"])

        return decision(F.struct(*[F.col(c) for c in self.features]))

    def transform(self, df: DataFrame, scaled: bool = False) -> DataFrame:
        """Adds ``score`` (signed decision value, negative = attack), ``is_anomaly``
        (score <= 0) and ``prediction`` (ATTACK / BENIGN)."""
        out = df.withColumn("score", self.decision_column(df, scaled))
        return out.withColumns({
            "is_anomaly": F.col("score") <= 0,
            "prediction": F.when(F.col("score") <= 0, F.lit("ATTACK")).otherwise(F.lit("BENIGN")),
        })

    # -- persistence (A9) -------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        d = len(self.features)
        lm = [(i, float(self.coef[i]), [float(v) for v in self.landmarks[i]]) for i in range(len(self.coef))]
        spark.createDataFrame(lm, "sv_id int, alpha double, x array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "landmarks"))
        spark.createDataFrame([(i, c, m, s) for i, (c, m, s) in enumerate(self.scaler.to_rows())],
                              "idx int, feature string, center double, scale double").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "scaler"))
        cfg = {"kernel": self.kernel, "gamma": self.gamma, "degree": self.degree, "coef0": self.coef0,
               "nu": self.nu, "rho": self.rho, "n_features": d, "scaler_kind": self.scaler.kind,
               "params": self.params, "metrics": self.metrics}
        spark.createDataFrame([(json.dumps(cfg, default=str),)], "config string").coalesce(1) \
            .write.mode("overwrite").json(os.path.join(path, "config"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "OneClassModel":
        cfg = json.loads(spark.read.json(os.path.join(path, "config")).collect()[0]["config"])
        sc = spark.read.parquet(os.path.join(path, "scaler")).orderBy("idx").collect()
        x, alpha = _vectors(spark.read.parquet(os.path.join(path, "landmarks")), len(sc))
        scaler = Scaler([r["feature"] for r in sc], [r["center"] for r in sc], [r["scale"] for r in sc],
                        cfg.get("scaler_kind", "standard"))
        return OneClassModel(scaler.features, scaler, x, alpha, float(cfg["rho"]),
                             cfg["kernel"], float(cfg["gamma"]), int(cfg["degree"]), float(cfg["coef0"]),
                             float(cfg["nu"]), cfg.get("params", {}), cfg.get("metrics", {}))

    def describe(self, spark: SparkSession) -> DataFrame:
        """One-row model description."""
        row = (type(self).__name__, self.kernel, float(self.nu), float(self.gamma), len(self.features),
               self.features[:10], int(len(self.coef)), float(self.rho), json.dumps(self.metrics, default=str))
        return spark.createDataFrame([row], "model_type string, kernel string, nu double, gamma double, "
                                            "n_features int, first_features array<string>, n_landmarks int, "
                                            "rho double, metrics string")


def _vectors(model_df: DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, alpha) of a support-vector table by sv_id, after a check of its size."""
    size = model_df.count() * (n_features + 1) * 8
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"support-vector table of {size} bytes exceeds MAX_MODEL_BYTES")
    t = model_df.orderBy("sv_id").select("x", "alpha").toArrow()
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(t.num_rows, n_features), t["alpha"].to_numpy().astype(np.float64)


def model_from_table(model_df: DataFrame, scaler: Scaler, features: list[str], rho: float, kernel: str = "rbf",
                     gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> OneClassModel:
    """Model from a support-vector table (sv_id, x array<double>, alpha), e.g. a fixed one."""
    x, alpha = _vectors(model_df, len(features))
    return OneClassModel(features, scaler, x, alpha, rho, kernel, gamma, degree, coef0)


# -- fitting (G8, G9) ------------------------------------------------------

def _balanced(src: DataFrame, hold) -> DataFrame:
    """Kept rows, dealt out anew if there are many and a few partitions hold them (a file of few row groups is read by few tasks):
    every pass of the fit would last as long as the fullest partition."""
    if not src.is_cached:
        return src
    slots = src.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in src.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    if sum(sizes) < SPREAD_ROWS or max(sizes) * slots < 3 * sum(sizes):
        return src
    even = hold(src.repartition(max(2 * slots, len(sizes))))
    even.count()
    src.unpersist()
    return even


BINS = "bin int, n long, low double, high double, k array<double>"


def _bins(z: DataFrame, features: list[str], L: np.ndarray, kernel_args: tuple, a: np.ndarray, edges: np.ndarray,
          low: float, high: float, summed: int) -> list:
    """One pass over the scaled rows: those with scores K(x, L) a from ``low`` to ``high`` by bins between ``edges`` (an edge
    belongs to the bin above it): count, least and greatest score, and for the first ``summed`` bins the sum of kernel rows.

    A task holds one row of m sums for each bin; these are added up by a shuffle, one row for each bin reaches the driver."""
    m = len(L)
    bc = z.sparkSession.sparkContext.broadcast((L, a, edges))
    names = [f.split()[0] for f in BINS.split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        L, a, edges = bc.value
        n = np.zeros(len(edges) + 1, np.int64)
        lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        sums = np.zeros((len(n), m))
        step = max(BLOCK_VALUES // m, 64)
        for batch in batches:
            X = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            for i in range(0, len(X), step):
                K = kernel_matrix(X[i:i + step], L, *kernel_args)
                s = np.einsum("ij,j->i", K, a)               # the same sum for the same row, wherever it stands
                rows = np.flatnonzero((s >= low) & (s <= high))
                at = np.searchsorted(edges, s[rows], side="right")
                order = np.argsort(at, kind="stable")
                rows, at = rows[order], at[order]
                if not len(at):
                    continue
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                b = at[first]
                n[b] += np.diff(np.append(first, len(at)))
                lo[b] = np.minimum(lo[b], np.minimum.reduceat(s[rows], first))
                hi[b] = np.maximum(hi[b], np.maximum.reduceat(s[rows], first))
                own = b < summed                             # the lowest bins, so the first rows
                if own.any():
                    sums[b[own]] += np.add.reduceat(K[rows[at < summed]], first[own], axis=0)
        b = np.flatnonzero(n)
        there = np.where(b < summed, m, 0)
        k = pa.ListArray.from_arrays(pa.array(np.append(0, there.cumsum()), pa.int32()), pa.array(sums[b[b < summed]].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(n[b]), pa.array(lo[b]), pa.array(hi[b]), k], names=names)

    def whole(t: pa.Table) -> pa.Table:
        k = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["k"].chunks])
        k = k.reshape(t.num_rows, -1).sum(0)
        return pa.table([t["bin"][:1], [sum(t["n"].to_pylist())], [min(t["low"].to_pylist())], [max(t["high"].to_pylist())],
                         pa.array([k], pa.list_(pa.float64()))], names=names)

    try:
        found = z.select(*features).mapInArrow(part, BINS).groupBy("bin").applyInArrow(whole, BINS).collect()
    finally:
        bc.destroy()
    return sorted(found, key=lambda r: r["bin"])


def _edges_near(scores: np.ndarray, nu: float, noise: float) -> np.ndarray:
    """Places, EDGES at most, that split scores finely around their nu-quantile: between neighbours among ``scores`` that differ by
    more than ``noise``, within five standard deviations of the quantile's rank."""
    s = np.sort(scores)
    reach = 5.0 * math.sqrt(nu * (1.0 - nu) * len(s)) + 2.0
    near = s[max(math.floor(nu * len(s) - reach), 0):math.ceil(nu * len(s) + reach) + 1]
    if not len(near):
        return np.empty(0)
    v = near[np.unique(np.linspace(0, len(near) - 1, EDGES + 1).astype(np.int64))]
    apart = np.flatnonzero(v[1:] - v[:-1] > noise)
    return np.unique(v[apart] + (v[apart + 1] - v[apart]) / 2.0)


def _edges_between(low: float, high: float) -> np.ndarray:
    """EDGES places above ``low`` and up to ``high``, evenly by their radix keys: passes over one bin after another are at most ten."""
    first, last = (int(k) for k in to_keys(np.array([low, high])))
    return np.array([to_value(k) for k in sorted({first - (first - last) * i // (EDGES + 1) for i in range(1, EDGES + 1)} - {first})])


def fit_one_class(train: DataFrame, features: list[str], kernel: str = "rbf", gamma="scale", nu: float = 0.05,
                  **kw) -> OneClassModel:
    """Distributed fit on (unscaled) benign training rows. ``hash_col`` orders the seeded
    landmark choice (F4). Returns a model whose training outlier share is close to nu."""
    return fit_one_class_nus(train, features, kernel, gamma, [nu], **kw)[0]


def fit_one_class_nus(train: DataFrame, features: list[str], kernel: str = "rbf", gamma="scale",
                      nus: list[float] = (0.05,), n_landmarks: int = 256, iterations: int = 40,
                      hash_col: str = "row_hash", degree: int = 3, coef0: float = 0.0,
                      scaler: Scaler | None = None, cache: bool = True, tol: float = 0.02,
                      on_failure: str = "raise") -> list[OneClassModel | FitFailure]:
    """One scaler and landmark set per (kernel, gamma), then one optimisation per nu value over the same cached rows. With ``on_failure="keep"`` a nu whose
    optimisation fails numerically has its ``FitFailure`` in its place."""
    if n_landmarks > MAX_LANDMARKS:
        raise ValueError("n_landmarks exceeds MAX_LANDMARKS")
    held = []                # tables kept for the scaler, gamma, landmark and optimisation jobs

    def hold(df: DataFrame) -> DataFrame:
        if cache:
            held.append(df.persist())
        return df

    try:
        return _fit_nus(train.select(hash_col, *features), features, kernel, gamma, nus, n_landmarks, iterations, hash_col,
                        degree, coef0, scaler, tol, on_failure, hold)
    finally:
        for t in held:
            t.unpersist()


def _fit_nus(src, features, kernel, gamma, nus, n_landmarks, iterations, hash_col, degree, coef0, scaler, tol, on_failure,
             hold) -> list[OneClassModel | FitFailure]:
    started = time.monotonic()
    src = _balanced(hold(src), hold)
    scaler = scaler or fit_standard(src, features)
    z = scaler.transform(src)
    g = gamma_value(gamma, z, features)
    L = seeded_sample(z, n_landmarks, hash_col).select(*features).toPandas().to_numpy(dtype=np.float64)
    Kmm = kernel_matrix(L, L, kernel, g, degree, coef0)
    Kmm = (Kmm + Kmm.T) / 2.0
    if not np.isfinite(Kmm).all():
        raise FitFailure("the kernel matrix of the landmarks is not finite")
    try:
        lam, U = np.linalg.eigh(Kmm)
    except np.linalg.LinAlgError as e:
        raise FitFailure(str(e)) from e
    keep = lam > 1e-10
    if not keep.any():
        raise FitFailure("the kernel matrix of the landmarks has no positive eigenvalue")
    Tm = U[:, keep] / np.sqrt(lam[keep])
    r = Tm.shape[1]
    kernel_args = (kernel, g, degree, coef0)
    m = len(L)
    all_rows = _bins(z, features, L, kernel_args, np.zeros(m), np.empty(0), -np.inf, np.inf, 1)
    n = sum(b["n"] for b in all_rows)
    w0 = Tm.T @ (np.array(all_rows[0]["k"]) / n) if n else np.full(r, np.nan)     # nu = 1 solution
    pivots = z.select(*features).sample(min(PIVOTS / n, 1.0), 42).toPandas().to_numpy(dtype=np.float64) if np.isfinite(w0).all() else L

    def pivot_scores(a: np.ndarray) -> np.ndarray:
        step = max(BLOCK_VALUES // m, 64)
        return np.concatenate([kernel_matrix(pivots[i:i + step], L, *kernel_args) @ a for i in range(0, max(len(pivots), 1), step)])

    def cut(w: np.ndarray, nu: float, sums: bool = True) -> tuple[float, np.ndarray]:
        """rho, the nu-quantile of the scores of all rows (a row's score; its rank is right within n / RANK_SHARE, and scores that
        differ by no more than rounding count as equal), and the sum of phi over the rows below it. One pass, if the pivots
        split the scores well; else the bin that holds the rank is split again."""
        if not np.isfinite(w).all():
            raise FitFailure("the scores of the training rows are not finite")
        a = Tm @ w
        noise = 32 * np.finfo(np.float64).eps * float((np.abs(Kmm) @ np.abs(a)).max())
        rank = min(max(math.ceil(nu * n), 1), n) - 1
        edges, low, high = _edges_near(pivot_scores(a), nu, noise), -np.inf, np.inf
        below, k = 0, np.zeros(m)
        while True:
            bins = _bins(z, features, L, kernel_args, a, edges, low, high, len(edges) if sums else 0)
            if low == -np.inf and sum(b["n"] for b in bins) < n:             # some score is no number
                raise FitFailure("the scores of the training rows are not finite")
            for b in bins[:-1]:
                if below + b["n"] > rank:
                    break
                below += b["n"]
                k += np.array(b["k"]) if sums else 0.0
            else:
                b = bins[-1]
            low, high = b["low"], b["high"]
            if not (np.isfinite(low) and np.isfinite(high)):
                raise FitFailure("the scores of the training rows are not finite")
            if rank - below <= n // RANK_SHARE or high - low <= noise:
                return low, Tm.T @ k
            edges = _edges_between(low, high)

    def solve(nu: float) -> tuple[np.ndarray, float]:
        w = w0.copy()
        for t in range(iterations):
            # the violators of the current w give the fixed-point target
            rho, violators = cut(w, nu)
            target = violators / (nu * n)
            # Frank-Wolfe step; w . (w - target) is the duality gap of the current iterate
            gap = float(w @ (w - target)) / max(float(w @ w), 1e-300)
            if gap < tol:
                return w, rho
            eta = 2.0 / (t + 2.0)
            w = (1.0 - eta) * w + eta * target
        return w, cut(w, nu, sums=False)[0]

    shared = (time.monotonic() - started) / len(nus)
    models = []
    for nu in nus:
        began = time.monotonic()
        try:
            w, rho = solve(nu)
        except FitFailure as e:
            if on_failure == "raise":
                raise
            models.append(e)
            continue
        models.append(OneClassModel(list(features), scaler, L, Tm @ w, rho, kernel, g, degree, coef0, nu,
                                    {"kernel": kernel, "gamma": gamma, "nu": nu, "n_landmarks": n_landmarks,
                                     "iterations": iterations, "n_train": n,
                                     "fit_seconds": round(shared + time.monotonic() - began, 3)}))
    return models


def fit_with_fallback(train: DataFrame, features: list[str], fallback_rows: int = 50_000, **kw) -> OneClassModel:
    """If the fit fails numerically, warn and refit on a seeded sample of ``fallback_rows`` rows. ``params`` of the model
    tells which it was (``fallback_used``). Other errors, such as a lost executor, are raised."""
    try:
        model = fit_one_class(train, features, **kw)
        model.params["fallback_used"] = False
    except FitFailure as e:
        warnings.warn(f"fit failed ({e}); refit on a sample of at most {fallback_rows} rows", stacklevel=2)
        model = fit_one_class(seeded_sample(train, fallback_rows, kw.get("hash_col", "row_hash")), features, **kw)
        model.params["fallback_used"] = True
    return model


# -- tuning (G13) ------------------------------------------------------------

def param_grid(spark: SparkSession, grid: dict | None = None, quick: bool = False) -> DataFrame:
    """The cartesian grid as a DataFrame in the reference's order (quick: first 10)."""
    grid = grid or (HYPERPARAM_GRID_QUICK if quick else HYPERPARAM_GRID)
    names = ["nu", "gamma", "kernel"]
    combos = list(product(*[grid[k] for k in names]))
    if quick:
        combos = combos[:10]
    rows = [(i, float(nu), str(g), k) for i, (nu, g, k) in enumerate(combos)]
    return spark.createDataFrame(rows, "idx int, nu double, gamma string, kernel string")


def tune(train: DataFrame, validation: DataFrame, features: list[str], grid_df: DataFrame, label_col: str = "Attack",
         **fit_kw) -> tuple[DataFrame, dict | None]:
    """Fit every grid row on ``train``, evaluate on ``validation``; the best is the first strictly greater F1, None
    if no combination could be fitted. The grid is bounded (72 rows), so it is iterated on the driver; rows sharing
    (kernel, gamma) share one scaler and landmark set, and all models are scored in one pass over
    ``validation``. A combination whose fit fails numerically keeps its row, with the reason in ``error`` and no metrics,
    and leaves the others; any other error is raised. ``fit_seconds``: its own optimisation and its share of what
    is shared; ``support_ratio``: landmarks with a weight by training rows. Returns (results table, best params)."""
    from flowlens.operators.evaluate import metrics_from_confusion
    spark = train.sparkSession
    scaler = fit_standard(train, features)
    rows = grid_df.orderBy("idx").collect()
    groups: dict[tuple, list] = {}
    for g in rows:
        groups.setdefault((g["kernel"], g["gamma"]), []).append(g)
    fitted: dict[int, OneClassModel] = {}
    errors: dict[int, str] = {}
    for (kernel, gamma_s), members in groups.items():  # one landmark set per (kernel, gamma)
        gamma = gamma_s if gamma_s in ("scale", "auto") else float(gamma_s)
        try:
            ms = fit_one_class_nus(train, features, kernel, gamma, [m["nu"] for m in members], scaler=scaler,
                                   on_failure="keep", **fit_kw)
        except FitFailure as e:                        # the landmarks' kernel matrix: no nu can be fitted
            ms = [e] * len(members)
        for g, m in zip(members, ms):
            if isinstance(m, FitFailure):
                errors[g["idx"]] = str(m)
            else:
                fitted[g["idx"]] = m
    cells = {}
    if fitted:
        scored = validation.select(F.col(label_col).alias("_y"),
                                   *[(m.decision_column(validation) <= 0).alias(f"p{i}") for i, m in fitted.items()])
        counts = scored.agg(*[F.count(F.when((F.col("_y") == y) & (F.col(f"p{i}") == bool(p)), 1)).alias(f"{name}{i}")
                              for i in fitted for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
        row = counts.collect()[0]
        cm = spark.createDataFrame([(i, *(row[f"{n}{i}"] for n in ("tn", "fp", "fn", "tp"))) for i in fitted],
                                   "idx int, tn bigint, fp bigint, fn bigint, tp bigint")
        cells = {r["idx"]: r for r in metrics_from_confusion(cm).collect()}
    results, best, best_f1 = [], None, -1.0
    for g in rows:  # pick the first strictly greater F1 in grid order
        i, model, m = g["idx"], fitted.get(g["idx"]), cells.get(g["idx"])
        if model is None:
            results.append((i, g["kernel"], str(g["gamma"]), float(g["nu"]), *[None] * 9, errors[i]))
            continue
        n_train = int(model.params["n_train"])
        results.append((i, g["kernel"], str(g["gamma"]), float(g["nu"]), float(model.gamma),
                        m["accuracy"], m["precision"], m["recall"], m["f1_score"], float(model.rho), n_train,
                        float(model.params["fit_seconds"]), float(np.count_nonzero(model.coef)) / n_train, None))
        if m["f1_score"] > best_f1:
            gamma = g["gamma"] if g["gamma"] in ("scale", "auto") else float(g["gamma"])
            best_f1, best = m["f1_score"], {"kernel": g["kernel"], "gamma": gamma, "nu": g["nu"]}
    res = spark.createDataFrame(results, "idx int, kernel string, gamma string, nu double, gamma_value double, "
                                         "accuracy double, precision double, recall double, f1_score double, "
                                         "rho double, n_train bigint, fit_seconds double, support_ratio double, error string")
    return res, best


def top_results(results: DataFrame, k: int = 5) -> DataFrame:
    """top k by F1, ties kept in grid order."""
    return results.orderBy(F.col("f1_score").desc_nulls_last(), F.col("idx").asc()).limit(k)
