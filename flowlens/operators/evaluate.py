"""Detection quality (operators G14-G20).

Everything derives from one confusion row per group: counts by ``count_if`` with partial
aggregation, then ratios with zero division -> 0 (each ratio is one division of two
integers, so values are exact and order-independent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.stats import safe_div
from flowlens.operators.quantiles import exact_quantiles


def confusion(df: DataFrame, y: str = "Attack", yhat: str = "yhat", by: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp (positive class = attack = 1), optionally per group. ``rows``: name of one more column that counts all
    rows, those without a class or a prediction too."""
    by = by or []
    Y, P = F.col(y) == 1, F.col(yhat) == 1
    aggs = [F.count(F.when(~Y & ~P, 1)).alias("tn"), F.count(F.when(~Y & P, 1)).alias("fp"),
            F.count(F.when(Y & ~P, 1)).alias("fn"), F.count(F.when(Y & P, 1)).alias("tp"),
            *([F.count(F.lit(1)).alias(rows)] if rows else [])]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _ratios() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1_score": safe_div(2 * tp, 2 * tp + fp + fn),
    }


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0)."""
    return cm.withColumns(_ratios())


def detection_rates(cm: DataFrame) -> DataFrame:
    """Benign / attack detection rate, specificity, false positive and negative rates."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.withColumns({
        "benign_detection_rate": safe_div(tn, tn + fp), "attack_detection_rate": safe_div(tp, tp + fn),
        "specificity": safe_div(tn, tn + fp), "fpr": safe_div(fp, fp + tn), "fnr": safe_div(fn, fn + tp),
    })


def class_report(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per-class precision, recall, F1, support plus macro and weighted averages."""
    by = by or []
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = []
    # class Benign (0): its "positives" are predicted-benign rows
    for cls, t_p, f_p, f_n, sup in (("Benign", tn, fn, fp, tn + fp), ("Attack", tp, fp, fn, tp + fn)):
        rows.append(F.struct(F.lit(cls).alias("class"), safe_div(t_p, t_p + f_p).alias("precision"),
                             safe_div(t_p, t_p + f_n).alias("recall"),
                             safe_div(2 * t_p, 2 * t_p + f_p + f_n).alias("f1_score"), sup.alias("support")))
    per = cm.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    agg_keys = by
    tot = per.groupBy(*agg_keys).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum("support").alias("n"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    macro = tot.select(*by, F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("n").alias("support"))
    weighted = tot.select(*by, F.lit("weighted avg").alias("class"), safe_div(F.col("wp"), F.col("n")).alias("precision"),
                          safe_div(F.col("wr"), F.col("n")).alias("recall"),
                          safe_div(F.col("wf"), F.col("n")).alias("f1_score"), F.col("n").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def score_summary(scored: DataFrame, score: str = "score", by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Min, max, mean, median, population std of decision scores. The groups of ``by`` are few (test sets, models): one
    row for each of them comes to the driver."""
    by = by or []
    aggs = [F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_mean")]
    std = F.stddev_pop(score).alias("score_std")
    if not exact:
        aggs += [F.percentile_approx(F.col(score), 0.5, 100000).alias("score_median"), std]
        return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)
    groups = scored.select(*by).distinct().collect() if by else [()]
    own = [F.lit(True) for _ in groups]
    for i, g in enumerate(groups):
        for c, v in zip(by, g, strict=True):
            own[i] = own[i] & F.col(c).eqNullSafe(F.lit(v))
    each = scored.select(*[F.when(o, F.col(score).cast("double")).alias(f"g{i}") for i, o in enumerate(own)])
    median = F.lit(None).cast("double")
    for o, (m,) in zip(own, exact_quantiles(each, each.columns, [0.5]).values(), strict=True):
        median = F.when(o, F.lit(m).cast("double")).otherwise(median)
    # the group's median, on each of its rows
    rows = scored.withColumn("_median", median)
    aggs += [F.max("_median").alias("score_median"), std]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def prediction_distribution(scored: DataFrame, col: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Rows per predicted class."""
    return scored.groupBy(*(by or []), col).agg(F.count(F.lit(1)).alias("n"))


def batch_totals(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, benign and attack counts of a scored batch, or of each batch of ``by``."""
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_flows"), F.count(F.when(~F.col("is_anomaly"), 1)).alias("benign_count"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("attack_count"))


def evaluate(scored: DataFrame, y: str = "Attack", yhat: str = "yhat", by: list[str] | None = None) -> DataFrame:
    """G14-G17 (and G20 with ``by=["test_set"]``) in one job: counts, metrics and rates."""
    return detection_rates(metrics_from_confusion(confusion(scored, y, yhat, by)))
