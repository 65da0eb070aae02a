"""Exact quantiles of many columns by radix selection.

A double becomes an unsigned 64-bit key of the same order. A pass counts the keys of each open range by digit, for all columns and
ranks at once: each task adds up one small table for each range (count, least and greatest key of every digit), the tables are
summed by a shuffle, and a running sum finds the digit that holds each rank. That digit's least and greatest key are the next
pass's range, split anew, until a range holds one value. The first digit is the key's leading bits, so most ranges are narrow
after one pass; nothing depends on how values are spread but the number of passes, at most ``ceil(64 / BITS)``. No buffer of values exists anywhere: a task
holds 2^BITS entries for each open range, whatever its input, and the driver gets one row for each rank.

Nulls and NaN are left out, -0.0 counts as 0.0, infinities are values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 13
DIGITS = 1 << BITS
SIGN = np.uint64(1 << 63)
HIST = "t int, digit int, n long, low long, high long"


def to_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ (bits >> 63 & np.int64(2**63 - 1))).view(np.uint64) ^ SIGN


def to_value(key: int) -> float:
    signed = np.uint64(key ^ (1 << 63)).view(np.int64)
    return float((signed ^ (signed >> np.int64(63) & np.int64(2**63 - 1))).view(np.float64))


def _stored(key: np.ndarray) -> np.ndarray:
    return (key ^ SIGN).view(np.int64)                       # a signed long of the same order


def _key(stored: int) -> int:
    return stored + 2**63


def digits(key: np.ndarray, low: int, high: int) -> np.ndarray:
    """Digit of each key of the range: its share of the range, in 2^BITS steps."""
    shift = max((high - low).bit_length() - BITS, 0)
    return ((key - np.uint64(low)) >> np.uint64(shift)).astype(np.int64)


def histogram(df: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """Counts by digit of the ranges (column number, least key, greatest key) of the columns of ``df``, which are doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ranges), DIGITS), np.int64)
        low = np.full((len(ranges), DIGITS), 2**64 - 1, np.uint64)
        high = np.zeros((len(ranges), DIGITS), np.uint64)
        for b in batches:
            keys: dict = {}
            for t, (c, lo, hi) in enumerate(ranges):
                if c not in keys:
                    v = b.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                    keys[c] = np.unique(to_keys(v[~np.isnan(v)]), return_counts=True)
                key, count = keys[c]
                a, z = np.searchsorted(key, np.uint64(lo)), np.searchsorted(key, np.uint64(hi), side="right")
                if a == z:
                    continue
                key, count = key[a:z], count[a:z]
                digit = digits(key, lo, hi)                   # ascending, as the keys are
                at = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
                d = digit[at]
                n[t, d] += np.add.reduceat(count, at)
                low[t, d] = np.minimum(low[t, d], key[at])
                high[t, d] = np.maximum(high[t, d], key[np.append(at[1:], len(key)) - 1])
        t, d = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(d, pa.int32()), pa.array(n[t, d]), pa.array(_stored(low[t, d])), pa.array(_stored(high[t, d]))],
                                         names=[f.split()[0] for f in HIST.split(", ")])

    return df.mapInArrow(run, HIST).groupBy("t", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[int, int], list[int]]) -> tuple[list[int], list[dict[int, float]]]:
    """The number of values of each column, and its values at ``ranks(column number, n)`` (from 0) in ascending order; ranks
    outside 0 to n - 1 are left out."""
    from flowlens.sources.io import materialize
    spark = df.sparkSession
    # narrowed per batch, so that the tables are not shipped with every value
    df = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out: list[dict[int, float]] = [{} for _ in columns]
    sizes = [0] * len(columns)
    ranges = [(i, 0, 2**64 - 1) for i in range(len(columns))]
    below = [0] * len(columns)                               # values in front of each range
    wanted: list[list[int]] | None = None
    while ranges:
        hist = materialize(histogram(df, ranges), "histogram")
        if wanted is None:
            for r in hist.groupBy("t").agg(F.sum("n").alias("n")).collect():
                sizes[r["t"]] = r["n"]
            wanted = [[k for k in sorted(set(ranks(t, n))) if 0 <= k < n] for t, n in enumerate(sizes)]
        asked = [(t, k - below[t]) for t, ks in enumerate(wanted) for k in ks]
        if not asked:
            break
        w = Window.partitionBy("t").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        steps = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        found = steps.join(F.broadcast(spark.createDataFrame(asked, "t int, k long")), "t").where("before <= k and k < before + n").collect()
        following: dict = {}
        for r in found:
            c, k = ranges[r["t"]][0], r["k"] + below[r["t"]]
            lo, hi = _key(r["low"]), _key(r["high"])
            if lo == hi:
                out[c][k] = to_value(lo)
            else:
                following.setdefault((c, lo, hi), (below[r["t"]] + r["before"], []))[1].append(k)
        ranges = list(following)
        below = [b for b, _ in following.values()]
        wanted = [ks for _, ks in following.values()]
    return sizes, out


def between(n: int, q: float) -> tuple[int, int, float]:
    """The ranks around quantile ``q`` of ``n`` values, and the place between them."""
    place = (n - 1) * q
    return math.floor(place), math.ceil(place), place


def interpolated(value: Callable[[int], float], n: int, q: float) -> float | None:
    """Quantile with linear interpolation, as Spark's ``percentile`` computes it."""
    if n <= 0:
        return None
    lo, hi, place = between(n, q)
    a, b = value(lo), value(hi)
    return a if a == b else (hi - place) * a + (place - lo) * b


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """The quantiles ``qs`` of each column; None where it has no value."""
    sizes, got = order_statistics(df, columns, lambda _, n: [k for q in qs for k in between(n, q)[:2]])
    return {c: [interpolated(got[i].__getitem__, sizes[i], q) for q in qs] for i, c in enumerate(columns)}


def filled_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, tuple[float | None, list[float | None]]]:
    """Each column's median, and its quantiles ``qs`` once its nulls are filled with that median (or with 0.0 where it has no value).

    The fills stand together in the middle of the order, so every rank of the filled column is known before the median is."""
    rows = df.agg(F.count(F.lit(1))).first()[0]

    def rank(k: int, n: int) -> int | None:
        """Where the value of rank ``k`` of the filled column stands among the values; None for a fill."""
        low = (n - 1) // 2 + 1                               # values that are not above the median
        return k if k < low else None if k < low + rows - n else k - (rows - n)

    def ranks(_: int, n: int) -> list[int]:
        filled = [rank(k, n) for q in qs for k in between(rows, q)[:2]]
        return [*between(n, 0.5)[:2], *(k for k in filled if k is not None)] if n else []

    sizes, got = order_statistics(df, columns, ranks)
    out = {}
    for c, n, values in zip(columns, sizes, got, strict=True):
        median = interpolated(values.__getitem__, n, 0.5)
        fill = 0.0 if median is None else median
        out[c] = median, [interpolated(lambda k: fill if not n or (at := rank(k, n)) is None else values[at], rows, q) for q in qs]  # noqa: B023
    return out
