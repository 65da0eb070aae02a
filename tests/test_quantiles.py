"""Radix selection against numpy, Spark's exact percentile and sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import clean, evaluate, quantiles as Q, scale

INF = float("inf")


def test_keys_keep_the_order_of_doubles():
    v = np.array([-INF, -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 2.5, 1e300, INF])
    keys = Q.to_keys(v)
    assert (np.diff(keys.astype(object)) > 0).all() and [Q.to_value(int(k)) for k in keys] == v.tolist()
    assert Q.to_keys(np.array([-0.0])) == Q.to_keys(np.array([0.0]))


def columns():
    rng = random.Random(8)
    n = 700
    return {
        "a": [rng.gauss(0, 1e6) for _ in range(n)], "b": [float(rng.randint(0, 3)) for _ in range(n)],
        "c": [rng.choice([None, math.nan, -1e-310, 1e308, 7.0]) for _ in range(n)], "d": [1.0 + k * 2**-52 for k in range(n)],
        "e": [None] * n, "f": [5.0] + [None] * (n - 1), "g": [rng.choice([INF, -INF, 0.0, -0.0]) for _ in range(n)], "h": [k * 10.0**(k % 600 - 300) for k in range(n)]}


def test_quantiles_match_percentile(spark):
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = Q.exact_quantiles(df, list(data), qs)
    values = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in data])
    want = values.agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in data]).first()
    for c in data:
        if c == "g":                                             # Spark interpolates between infinities to NaN
            assert got[c][0] == -INF and got[c][-1] == INF
        else:
            assert got[c] == (want[c] if want[c] is not None else [None] * len(qs)), c


def test_quantiles_of_filled_columns(spark):
    data = {c: v for c, v in columns().items() if c != "g"}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data))
    df = clean.inf_to_null(df, list(data))
    got = Q.filled_quantiles(df, list(data), [0.01, 0.4, 0.5, 0.6, 0.99])
    filled = clean.impute_median(df, list(data))
    want = filled.agg(*[F.percentile(c, F.array(*map(F.lit, [0.01, 0.4, 0.5, 0.6, 0.99]))).alias(c) for c in data]).first()
    assert {c: q for c, (_, q) in got.items()} == {c: want[c] for c in data}


def test_one_pass_cleaning_equals_two_steps(spark):
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data))
    cols = list(data)
    one = clean.impute_and_cap(df, cols).collect()
    two = clean.cap_extremes(clean.impute_median(df, cols), cols).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert Q.exact_quantiles(empty, ["x", "y"], [0.5]) == {"x": [None], "y": [None]}
    assert clean.impute_and_cap(empty, ["x", "y"]).count() == 0 and clean.cap_extremes(empty, []).count() == 0
    s = scale.fit_robust(empty, ["x"])
    assert s.center == [0.0] and s.scale == [1.0]


@pytest.mark.parametrize("by", [None, ["s"]])
def test_score_summary(spark, by):
    rng = np.random.default_rng(2)
    rows = [(None if k % 3 == 0 else f"set{k % 3}", float(v)) for k, v in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "s string, score double")
    got = {(r["s"] if by else 0): r["score_median"] for r in evaluate.score_summary(df, by=by).collect()}
    want = {g: float(np.median([v for s, v in rows if not by or s == g])) for g in ({s for s, _ in rows} if by else {0})}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_a_pass_holds_one_table_for_each_range(spark):
    df = spark.range(100_000).select(F.sin("id").alias("x"), F.lit(3.0).alias("y"))
    hist = Q.histogram(df, [(0, 0, 2**64 - 1), (1, 0, 2**64 - 1)]).collect()
    assert sum(r["n"] for r in hist if r["t"] == 0) == 100_000 and len(hist) <= 2 * Q.DIGITS
    assert [r["n"] for r in hist if r["t"] == 1] == [100_000]
