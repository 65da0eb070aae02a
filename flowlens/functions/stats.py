"""Scalar and aggregate helpers (S1-S14 and exact moment statistics).

Statistics are built from exact integer moments - count, sum and sum of squares - and
finished with single IEEE operations. Sums of integers are associative, so the result
does not depend on partitioning, partial aggregation or row order, and the same formula
in SQL gives bit-identical doubles. Variance is the population variance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"


def fcount(cond: Column) -> Column:
    """count_if that is a bigint and 0 for an empty group."""
    return F.count(F.when(cond, F.lit(1)))


def dsum(x: Column, cond: Column | None = None) -> Column:
    """Sum (bigint) of x over rows where cond holds; 0 when none."""
    v = x if cond is None else F.when(cond, x)
    return F.coalesce(F.sum(v), F.lit(0).cast("long"))


def sumsq(x: Column, cond: Column | None = None, wide: bool = False) -> Column:
    """Exact sum of squares; ``wide`` uses decimal(38,0) for values that may overflow bigint."""
    v = x.cast(DEC) * x.cast(DEC) if wide else x * x
    if cond is not None:
        v = F.when(cond, v)
    return F.coalesce(F.sum(v), F.lit(0).cast(DEC if wide else "long"))


def to_double(x: Column) -> Column:
    return x.cast("double")


def mean_of(n: Column, s1: Column, scale: float = 1.0) -> Column:
    """s1 / n / scale; 0 for n = 0."""
    m = s1.cast("double") / n.cast("double")
    if scale != 1.0:
        m = m / F.lit(scale)
    return F.when(n > 0, m).otherwise(F.lit(0.0))


def var_of(n: Column, s1: Column, s2: Column) -> Column:
    """Population variance from exact moments; 0 for n = 0."""
    num = (n.cast(DEC) * s2.cast(DEC) - s1.cast(DEC) * s1.cast(DEC)).cast("double")
    den = n.cast("double") * n.cast("double")
    return F.when(n > 0, num / den).otherwise(F.lit(0.0))


def std_of(n: Column, s1: Column, s2: Column, scale: float = 1.0) -> Column:
    s = F.sqrt(var_of(n, s1, s2))
    if scale != 1.0:
        s = s / F.lit(scale)
    return s


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b as double, ``default`` when b is 0 or null."""
    return F.when(b.isNotNull() & (b != 0), a.cast("double") / b.cast("double")).otherwise(F.lit(default))


def is_bad_double(x: Column) -> Column:
    """Null, NaN or +/-inf."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def safe_double(x: Column) -> Column:
    """Text to double; empty, null or text -> 0.0 (ANSI-safe)."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def finite_or_zero(x: Column) -> Column:
    """+/-inf, NaN and null -> 0.0 (NaN compares above +inf in Spark, null is not < inf)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(0.0))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Clip x into [lo, hi]."""
    return F.greatest(F.least(x, hi), lo)


def epoch_us_to_string(us: Column) -> Column:
    """S11: 'yyyy-MM-dd HH:mm:ss' of epoch microseconds in the session time zone (UTC)."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
