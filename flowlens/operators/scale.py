"""Feature scaling and kernel width (operators G5-G7).

Fitting is one aggregation over all feature columns; the fitted parameters (two numbers
per column) are applied as literals, so transforming is a plain projection inside
whole-stage codegen. Standard scaling uses the population standard deviation and maps
a zero deviation to 1, as the reference's scaler does (``ml.StandardScaler`` would use
the sample deviation).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.quantiles import exact_quantiles


@dataclass
class Scaler:
    features: list[str]
    center: list[float]
    scale: list[float]
    kind: str = "standard"

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.features, self.center, self.scale)})

    def to_rows(self) -> list[tuple]:
        return [(c, float(m), float(s)) for c, m, s in zip(self.features, self.center, self.scale)]


def fit_standard(df: DataFrame, features: list[str]) -> Scaler:
    """Mean and population std per column; std 0 -> 1."""
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    center = [float(row[f"m{i}"] or 0.0) for i in range(len(features))]
    scale = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(features))]
    return Scaler(list(features), center, scale, "standard")


def fit_robust(df: DataFrame, features: list[str], exact: bool = True, accuracy: int = 100000) -> Scaler:
    """Median and interquartile range per column; IQR 0 -> 1, a column without values 0 and 1."""
    qs = [0.25, 0.5, 0.75]
    if exact:
        found = exact_quantiles(df, features, qs)
    else:
        row = df.agg(*[F.percentile_approx(F.col(c), F.array(*map(F.lit, qs)), accuracy).alias(f"q{i}") for i, c in enumerate(features)]).collect()[0]
        found = {c: row[f"q{i}"] or [None] * 3 for i, c in enumerate(features)}
    center, scale = [], []
    for c in features:
        q25, q50, q75 = found[c]
        center.append(0.0 if q50 is None else float(q50))
        scale.append((float(q75) - float(q25) if q50 is not None else 0.0) or 1.0)
    return Scaler(list(features), center, scale, "robust")


def gamma_value(gamma, scaled: DataFrame, features: list[str]) -> float:
    """G7: 'scale' = 1 / (d * variance of all cells), 'auto' = 1 / d, else the number."""
    d = len(features)
    if gamma == "auto":
        return 1.0 / d
    if gamma != "scale":
        return float(gamma)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs += [F.sum(c).alias(f"s{i}"), F.sum(F.col(c) * F.col(c)).alias(f"q{i}")]
    row = scaled.agg(*aggs).collect()[0]
    cells = row["n"] * d
    if cells == 0:
        return 1.0 / d
    mean = sum(row[f"s{i}"] or 0.0 for i in range(d)) / cells
    var = sum(row[f"q{i}"] or 0.0 for i in range(d)) / cells - mean * mean
    return 1.0 / (d * var) if var > 0 else 1.0


def gamma_scale_sql_parts(scaled: DataFrame, features: list[str]) -> DataFrame:
    """G7 as a one-row DataFrame (n, d, cell mean, cell variance, gamma_scale, gamma_auto)."""
    d = len(features)
    tot = sum((F.col(c) for c in features[1:]), F.col(features[0]))
    sq = sum((F.col(c) * F.col(c) for c in features[1:]), F.col(features[0]) * F.col(features[0]))
    a = scaled.agg(F.count(F.lit(1)).alias("n"), F.sum(tot).alias("s1"), F.sum(sq).alias("s2"))
    cells = F.col("n").cast("double") * F.lit(float(d))
    mean = F.col("s1") / cells
    var = F.col("s2") / cells - mean * mean
    return a.select(F.col("n"), F.lit(d).alias("d"), mean.alias("cell_mean"), var.alias("cell_var"),
                    (F.lit(1.0) / (F.lit(float(d)) * var)).alias("gamma_scale"), F.lit(1.0 / d).alias("gamma_auto"))
