"""Cleaning of labelled flow tables (operators B10-B19).

Column statistics (constants, medians, quantiles) are computed by one aggregation over
all columns; the single result row - bounded by the number of columns - comes back to
the driver and is applied as literals in the next projection. Medians and quantiles are exact, by radix
selection over all columns at once (``quantiles``); ``exact=False`` takes ``percentile_approx``, a bounded sketch per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.stats import clip, is_bad_double
from flowlens.operators.quantiles import exact_quantiles, filled_quantiles
from flowlens.schemas import BENIGN_LABEL, ID_COLUMNS_DEFAULT, ID_COLUMNS_PAPER

INF = float("inf")


def strip_column_names(df: DataFrame) -> DataFrame:
    """Strip whitespace around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def trim_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Strip label values."""
    return df.withColumn(label, F.trim(F.col(label)))


def drop_identifier_columns(df: DataFrame, profile: str = "default", extra: list[str] | None = None) -> DataFrame:
    """Drop identifier columns that exist (the paper profile keeps the duplicate header column)."""
    cols = (ID_COLUMNS_PAPER if profile == "paper" else ID_COLUMNS_DEFAULT) + list(extra or [])
    return df.drop(*[c for c in cols if c in df.columns])


def _nan_to_null(c: str, dtype: str) -> Column:
    x = F.col(c)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(x), x)
    return x


def constant_columns(df: DataFrame, protect: tuple[str, ...] = ("label", "Attack")) -> list[str]:
    """Columns with at most one distinct non-null value (NaN counts as null, inf as a value)."""
    cols = [c for c, _ in df.dtypes if c not in protect]
    if not cols:
        return []
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        v = _nan_to_null(c, types[c])
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        if mn is None or mn == mx:
            out.append(c)
    return out


def drop_constant_columns(df: DataFrame, protect: tuple[str, ...] = ("label", "Attack")) -> DataFrame:
    return df.drop(*constant_columns(df, protect))


def drop_duplicate_column(df: DataFrame, dup: str, twin: str) -> DataFrame:
    """Drop ``dup`` when every row equals ``twin`` (null-safe; NaN equals NaN)."""
    if dup not in df.columns or twin not in df.columns:
        return df
    differs = df.agg(F.count(F.when(~F.col(dup).eqNullSafe(F.col(twin)), 1)).alias("d")).collect()[0]["d"]
    return df.drop(dup) if differs == 0 else df


def with_attack_target(df: DataFrame, label: str = "label", target: str = "Attack") -> DataFrame:
    """Binary target, 1 unless the label is BENIGN."""
    return df.withColumn(target, (F.col(label) != F.lit(BENIGN_LABEL)).cast("int"))


def bad_value_profile(df: DataFrame, cols: list[str], large: float = 1e10) -> DataFrame:
    """Per column inf count, null-or-NaN count, count of finite |x| > 1e10, has-inf flag.

    One wide aggregation, then one row per column (unpivot of a single row)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(F.when(F.abs(x) == INF, 1)).alias(f"i{i}"),
                 F.count(F.when(x.isNull() | F.isnan(x), 1)).alias(f"n{i}"),
                 F.count(F.when((F.abs(x) > large) & (F.abs(x) != INF), 1)).alias(f"l{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"i{i}").alias("inf_count"),
                              F.col(f"n{i}").alias("null_count"), F.col(f"l{i}").alias("large_count"))
                     for i, c in enumerate(cols)])
    return (wide.select(F.explode(rows).alias("r")).select("r.*")
            .withColumn("has_inf", F.col("inf_count") > 0))


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """B16 step 1: +/-inf and NaN -> null (Spark's max/avg would propagate NaN)."""
    return df.withColumns({c: F.when(~is_bad_double(F.col(c)), F.col(c)) for c in cols})


def column_medians(df: DataFrame, cols: list[str], exact: bool = True, accuracy: int = 100000, means: bool = True) -> dict:
    """Median of each column and, with ``means``, its mean; None where it has no value."""
    if not cols:
        return {}
    aggs = [F.avg(F.col(c)).alias(f"a{i}") for i, c in enumerate(cols) if means]
    aggs += [F.percentile_approx(F.col(c), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(cols) if not exact]
    row = df.agg(*aggs).collect()[0] if aggs else None
    medians = exact_quantiles(df, cols, [0.5]) if exact else {c: [row[f"m{i}"]] for i, c in enumerate(cols)}
    return {c: (medians[c][0], row[f"a{i}"] if means else None) for i, c in enumerate(cols)}


def impute_median(df: DataFrame, cols: list[str], exact: bool = True, fallback: str = "zero") -> DataFrame:
    """inf/NaN -> null, then fill with the column median; all-null columns get 0
    (``fallback="mean"`` tries the mean first, as the exploration notebook does)."""
    df = inf_to_null(df, cols)
    stats = column_medians(df, cols, exact, means=fallback == "mean")
    fills = {}
    for c in cols:
        med, mean = stats[c]
        v = med if med is not None else (mean if fallback == "mean" and mean is not None else 0.0)
        fills[c] = F.coalesce(F.col(c), F.lit(float(v)))
    return df.withColumns(fills)


def cap_extremes(df: DataFrame, cols: list[str], lo_q: float = 0.01, hi_q: float = 0.99,
                 threshold: float = 1e8, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """Clip a column to [q01, q99] only when q99 > 1e8 or q01 < -1e8."""
    if not cols:
        return df
    if exact:
        found = exact_quantiles(df, cols, [lo_q, hi_q])
    else:
        row = df.agg(*[F.percentile_approx(F.col(c), F.array(F.lit(lo_q), F.lit(hi_q)), accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).collect()[0]
        found = {c: row[f"q{i}"] or [None, None] for i, c in enumerate(cols)}
    return df.withColumns(_caps(found, threshold, lambda c: F.col(c)))


def _caps(quantiles: dict, threshold: float, value) -> dict[str, Column]:
    out = {}
    for c, (lo, hi) in quantiles.items():
        if lo is not None and (hi > threshold or lo < -threshold):
            out[c] = clip(value(c), F.lit(float(lo)), F.lit(float(hi)))
    return out


def impute_and_cap(df: DataFrame, cols: list[str], lo_q: float = 0.01, hi_q: float = 0.99, threshold: float = 1e8) -> DataFrame:
    """B16 and B17 in the same passes: the quantiles of the filled columns follow from those of the values."""
    if not cols:
        return df
    df = inf_to_null(df, cols)
    found = filled_quantiles(df, cols, [lo_q, hi_q])
    filled = {c: F.coalesce(F.col(c), F.lit(0.0 if median is None else float(median))) for c, (median, _) in found.items()}
    return df.withColumns({**filled, **_caps({c: q for c, (_, q) in found.items()}, threshold, filled.__getitem__)})


def drop_bad_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remove rows that still hold null, NaN or inf in a feature."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_bad_double(F.col(c))
    return df.filter(cond)


def validate(df: DataFrame, cols: list[str]) -> dict:
    """Assert no inf and no null remain; return the overall min and max."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(F.when(is_bad_double(F.col(c)), 1)).alias(f"b{i}"),
                 F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
    row = df.agg(*aggs).collect()[0]
    bad = {c: row[f"b{i}"] for i, c in enumerate(cols) if row[f"b{i}"]}
    if bad:
        raise ValueError(f"non-finite values remain: {bad}")
    mins = [row[f"mn{i}"] for i in range(len(cols)) if row[f"mn{i}"] is not None]
    maxs = [row[f"mx{i}"] for i in range(len(cols)) if row[f"mx{i}"] is not None]
    return {"min": min(mins) if mins else None, "max": max(maxs) if maxs else None}


def feature_columns(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and t in ("double", "float", "int", "bigint", "smallint")]


def clean_labelled(df: DataFrame, label: str = "label", profile: str = "default", mode: str = "full",
                   keep: tuple[str, ...] = (), exact: bool = True, duplicate: tuple[str, str] | None = None) -> DataFrame:
    """Composition of B10-B18 in the order of the chosen profile.

    ``default``: strip -> drop identifier and constant columns -> target -> inf/NaN to
    null -> median fill -> cap (modes full/large/medium) -> drop remaining bad rows.
    ``paper``: strip -> fix values first (no capping) -> drop identifiers, the duplicate
    column if equal, constants -> target. ``keep`` columns (keys) are never touched.
    """
    protect = (label, "Attack", *keep)
    df = trim_label(strip_column_names(df), label)
    if profile == "paper":
        cols = feature_columns(df, protect)
        df = drop_bad_rows(impute_median(df, cols, exact), cols)
        df = drop_identifier_columns(df, "paper")
        if duplicate:
            df = drop_duplicate_column(df, *duplicate)
        df = drop_constant_columns(df, protect)
        return with_attack_target(df, label)
    df = drop_identifier_columns(df, "default")
    df = drop_constant_columns(df, protect)
    df = with_attack_target(df, label)
    cols = feature_columns(df, protect)
    if exact and mode in ("full", "large", "medium"):
        return drop_bad_rows(impute_and_cap(df, cols), cols)
    df = impute_median(df, cols, exact)
    if mode in ("full", "large", "medium"):
        df = cap_extremes(df, cols, exact=exact)
    return drop_bad_rows(df, cols)
