"""Seeded sampling, splits and label sets (operators F4, F7, F8, E2, G1-G4).

Randomness is a deterministic row hash: ``md5(concat_ws('|', seed, key...))``. A split is a
threshold on its first 8 hex digits (0.8 * 2^32 = 'cccccccc'), so it needs no shuffle and
gives the same rows for any partitioning. An exact-size sample takes the n lowest hashes;
for large n only the hash-prefix histogram (at most 65,536 rows) reaches the driver and no
task ever holds n rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.schemas import BENIGN_LABEL, UNKNOWN_LABEL_EXACT, UNKNOWN_LABEL_SUBSTRINGS

SMALL_SAMPLE = 100_000


def row_hash(key_cols: list[str], seed: int = 42) -> Column:
    """md5 of ``seed|key1|key2...`` as a hex string."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def hash_threshold(fraction: float) -> str:
    """8-hex-digit threshold: rows with hash prefix < threshold form ``fraction`` of the data."""
    return format(min(int(round(fraction * 2 ** 32)), 2 ** 32 - 1), "08x")


def in_fraction(fraction: float, hash_col: str = "row_hash") -> Column:
    return F.substring(F.col(hash_col), 1, 8) < F.lit(hash_threshold(fraction))


def seeded_sample(df: DataFrame, n: int, hash_col: str = "row_hash") -> DataFrame:
    """exactly min(n, count) rows - the n lowest row hashes.

    Small n: ``orderBy(hash).limit(n)`` (top-n per task, merged). Large n: count rows per
    4-hex-digit prefix, keep every row below the boundary prefix, top-n only inside it.
    """
    if n <= SMALL_SAMPLE:
        return df.orderBy(hash_col).limit(n)
    prefix = F.substring(F.col(hash_col), 1, 4)
    hist = df.groupBy(prefix.alias("p")).count().orderBy("p").collect()  # <= 65,536 rows
    cum, boundary, below = 0, None, 0
    for r in hist:
        if cum + r["count"] >= n:
            boundary, below = r["p"], cum
            break
        cum += r["count"]
    if boundary is None:
        return df
    whole = df.filter(prefix < F.lit(boundary))
    edge = df.filter(prefix == F.lit(boundary)).orderBy(hash_col).limit(n - below)
    return whole.unionByName(edge)


def is_unknown_label(label: Column) -> Column:
    """Contains 'slowloris' or 'slowhttptest', or equals 'bot' (case-insensitive)."""
    low = F.lower(label)
    cond = F.lit(False)
    for s in UNKNOWN_LABEL_SUBSTRINGS:
        cond = cond | low.contains(s)
    for s in UNKNOWN_LABEL_EXACT:
        cond = cond | (low == F.lit(s))
    return cond


def unknown_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """The distinct unknown-attack labels present."""
    return df.select(label).distinct().filter(is_unknown_label(F.col(label)))


def check_unknown_labels(df: DataFrame, label: str = "label", least: int = 3) -> list[str]:
    """The unknown-attack labels present, few as they are, with a warning if there are fewer than ``least``."""
    found = sorted(r[0] for r in unknown_labels(df, label).collect())
    if len(found) < least:
        warnings.warn(f"{len(found)} unknown-attack labels, {least} expected: {found}", stacklevel=2)
    return found


def label_kind(label: Column) -> Column:
    """benign / unknown / known attack class of a (trimmed) label."""
    return (F.when(label == F.lit(BENIGN_LABEL), F.lit("benign"))
            .when(is_unknown_label(label), F.lit("unknown")).otherwise(F.lit("known")))


def benign_split(df: DataFrame, label: str = "label", train_fraction: float = 0.8,
                 hash_col: str = "row_hash") -> DataFrame:
    """G1: ``part`` = train for 80% of benign rows, test for the other benign rows and all attacks."""
    benign = F.col(label) == F.lit(BENIGN_LABEL)
    return df.withColumn("part", F.when(benign & in_fraction(train_fraction, hash_col), F.lit("train"))
                         .otherwise(F.lit("test")))


def paper_split(df: DataFrame, label: str = "label", train_fraction: float = 0.8,
                hash_col: str = "row_hash") -> DataFrame:
    """Rows tagged ``test_set`` in {train, overall, unknown}.

    train = 80% benign; overall = the other benign rows + known + unknown attacks;
    unknown = min(#unknown, #benign test) benign test rows (lowest hashes) + unknown attacks.
    A benign test row can appear in both test sets.
    """
    kind = label_kind(F.col(label))
    t = df.withColumn("_kind", kind).withColumn(
        "_train", (F.col("_kind") == "benign") & in_fraction(train_fraction, hash_col))
    train = t.filter(F.col("_train")).withColumn("test_set", F.lit("train"))
    overall = t.filter(~F.col("_train")).withColumn("test_set", F.lit("overall"))
    counts = t.agg(F.count(F.when(F.col("_kind") == "unknown", 1)).alias("u"),
                   F.count(F.when((F.col("_kind") == "benign") & ~F.col("_train"), 1)).alias("b")).collect()[0]
    n_unknown, n_benign_test = counts["u"], counts["b"]
    parts = [train, overall]
    if n_unknown > 0 and n_benign_test > 0:
        k = min(n_unknown, n_benign_test)
        benign_test = t.filter((F.col("_kind") == "benign") & ~F.col("_train"))
        parts.append(seeded_sample(benign_test, k, hash_col).withColumn("test_set", F.lit("unknown")))
        parts.append(t.filter(F.col("_kind") == "unknown").withColumn("test_set", F.lit("unknown")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)  # F7
    return out.drop("_kind", "_train")


def stratified_split(df: DataFrame, strata: str, train_fraction: float = 0.8, hash_col: str = "row_hash") -> DataFrame:
    """``part`` in {train, test}; of each stratum's n rows the floor(n * fraction + 0.5) lowest hashes train.

    Ranks are counted within (stratum, first three hex digits of the hash) and shifted by a running sum over
    that summary (at most 4,096 rows a stratum), so no task holds a whole stratum. A null stratum is one too."""
    from pyspark.sql import Window
    b = df.withColumn("_cell", F.substring(hash_col, 1, 3))
    cell = b.groupBy(F.col(strata).alias("_s"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_s")
    cell = cell.withColumns({
        "_below": F.coalesce(F.sum("_n").over(whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_take": F.floor(F.sum("_n").over(whole) * F.lit(train_fraction) + F.lit(0.5))}).drop("_n")
    rank = F.row_number().over(Window.partitionBy(strata, "_cell").orderBy(hash_col))
    j = b.withColumn("_rank", rank).join(cell, F.col(strata).eqNullSafe(F.col("_s")) & F.col("_cell").eqNullSafe(F.col("_c")))
    part = F.when(F.col("_rank") + F.col("_below") <= F.col("_take"), F.lit("train")).otherwise(F.lit("test"))
    return j.withColumn("part", part).drop("_cell", "_rank", "_s", "_c", "_below", "_take")


def composition(df: DataFrame, label: str = "label", set_col: str | None = None) -> DataFrame:
    """F8: benign / known / unknown counts and percentages (per test set if given)."""
    keys = [set_col] if set_col else []
    k = df.withColumn("kind", label_kind(F.col(label)))
    g = k.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    tot = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("pct", F.col("n").cast("double") * 100.0 / tot.cast("double"))


def label_membership(df: DataFrame, labels: DataFrame, label: str = "label", how: str = "left_semi",
                     broadcast_limit: int = 10_000) -> DataFrame:
    """Rows whose label is (left_semi) or is not (left_anti) in ``labels``.

    The label set is broadcast only after its size is checked; beyond the limit the join
    is a regular shuffle join."""
    lab = labels.select(F.col(labels.columns[0]).alias("_lab")).distinct()
    if lab.limit(broadcast_limit + 1).count() <= broadcast_limit:
        lab = F.broadcast(lab)
    return df.join(lab, F.col(label) == F.col("_lab"), how)
