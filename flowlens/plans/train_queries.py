"""Registered training-side queries (E-3) over the labelled view, with DuckDB oracles.

Scores and fitted scaler outputs go through ``exp``/``sqrt`` and floating sums whose order
differs between engines, so those columns are rounded to 9 decimals in both texts;
counts and ratios of counts are compared exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import clean, evaluate as ev, split
from flowlens.operators.oneclass import fit_one_class, model_from_table, param_grid, top_results, tune
from flowlens.operators.scale import fit_robust, fit_standard, gamma_scale_sql_parts
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures import duckdb_view

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATS = ["f0", "f1", "f2", "f3", "f4", "f5"]
KEEP = tuple(KEYS + ["ship_day", "file_no", "row_hash"])
MODEL_FEATS = ["f0", "f2"]
GAMMA, RHO, N_SV = 0.25, 0.3, 8

LAB = f"lab AS ({duckdb_view('labelled')}), t AS (SELECT * EXCLUDE (label), trim(label) AS label FROM lab)"
K = ", ".join(KEYS)


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.trim_label(fx.labelled(spark, sf_dir))


def _unknown_sql(x: str = "label") -> str:
    return (f"(contains(lower({x}), 'slowloris') OR contains(lower({x}), 'slowhttptest') OR lower({x}) = 'bot')")


def _kind_sql(x: str = "label") -> str:
    return f"CASE WHEN {x} = 'BENIGN' THEN 'benign' WHEN {_unknown_sql(x)} THEN 'unknown' ELSE 'known' END"


TRAIN_SQL = "(label = 'BENIGN' AND substr(row_hash, 1, 8) < 'cccccccc')"


def _order_cte(name: str, src: str, col: str) -> str:
    """Ranked non-null values of one column (for exact quantiles in the oracle)."""
    return f"{name} AS (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS i FROM {src} WHERE {col} IS NOT NULL)"


def _quantile_sql(ranked: str, p: float) -> str:
    """Exact linear-interpolated quantile written with the operation order of Spark's
    ``percentile``: pos = (n - 1) p; (ceil - pos) * lo + (pos - floor) * hi."""
    return (f"(SELECT CASE WHEN ceil(pos) = floor(pos) OR hi = lo THEN lo "
            f"ELSE (ceil(pos) - pos) * lo + (pos - floor(pos)) * hi END FROM "
            f"(SELECT pos, (SELECT v FROM {ranked} WHERE i = floor(pos)) AS lo, "
            f"(SELECT v FROM {ranked} WHERE i = ceil(pos)) AS hi FROM "
            f"(SELECT CAST(count(*) - 1 AS DOUBLE) * {p} AS pos FROM {ranked})))")


# -- F1, F2, F3, B12, B15 --------------------------------------------------------

def label_distribution(spark, sf_dir):
    return _lab(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(spark, sf_dir):
    return _lab(spark, sf_dir).select("label").distinct().withColumn("is_unknown", split.is_unknown_label(F.col("label")))


def column_profile(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    prof = clean.bad_value_profile(lab, FEATS)
    aggs = []
    for i, c in enumerate(FEATS):
        v = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.count_distinct(v).alias(f"d{i}")]
    dist = lab.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(FEATS)])
    dist = dist.select(F.explode(rows).alias("r")).select("r.*")
    const = set(clean.constant_columns(lab.select(*FEATS)))
    out = prof.join(dist, "column")
    return out.withColumn("is_constant", F.col("column").isin(*const) if const else F.lit(False))


def _column_profile_sql():
    parts = []
    for c in FEATS:
        parts.append(f"""SELECT '{c}' AS "column",
 count(*) FILTER (WHERE abs({c}) = 'Infinity'::DOUBLE) AS inf_count,
 count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS null_count,
 count(*) FILTER (WHERE abs({c}) > 1e10 AND abs({c}) <> 'Infinity'::DOUBLE) AS large_count,
 count(*) FILTER (WHERE abs({c}) = 'Infinity'::DOUBLE) > 0 AS has_inf,
 count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END) AS n_distinct,
 coalesce(min(CASE WHEN NOT isnan({c}) THEN {c} END) = max(CASE WHEN NOT isnan({c}) THEN {c} END), true) AS is_constant
 FROM t""")
    return f"WITH {LAB}\n" + "\nUNION ALL\n".join(parts)


# -- B16-B18 and the two cleaning profiles ------------------------------------------

def impute_and_cap(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    x = clean.impute_median(lab, FEATS, exact=True)
    x = clean.cap_extremes(x, FEATS, exact=True)
    return clean.drop_bad_rows(x, FEATS).select(*KEYS, *FEATS)


def _impute_cap_sql(fe: list[str], cols_out: str, extra: str = "", cap: bool = True) -> str:
    nul = ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR abs({c}) = 'Infinity'::DOUBLE THEN NULL ELSE {c} END AS {c}"
                    for c in fe)
    ranked_n = ", ".join(_order_cte(f"rn_{c}", "n", c) for c in fe)
    med = ", ".join(f"{_quantile_sql(f'rn_{c}', 0.5)} AS m_{c}" for c in fe)
    fill = ", ".join(f"coalesce({c}, coalesce(m_{c}, 0.0)) AS {c}" for c in fe)
    head = f"""WITH {LAB},
n AS (SELECT {K}{extra}, {nul} FROM t),
{ranked_n},
m AS (SELECT {med}),
f AS (SELECT {K}{extra}, {fill} FROM n, m)"""
    if not cap:
        return head + f"\nSELECT {cols_out} FROM f"
    ranked_f = ", ".join(_order_cte(f"rf_{c}", "f", c) for c in fe)
    q = ", ".join(f"{_quantile_sql(f'rf_{c}', 0.01)} AS lo_{c}, {_quantile_sql(f'rf_{c}', 0.99)} AS hi_{c}" for c in fe)
    capped = ", ".join(f"CASE WHEN hi_{c} > 1e8 OR lo_{c} < -1e8 THEN greatest(least({c}, hi_{c}), lo_{c}) ELSE {c} END AS {c}"
                       for c in fe)
    return head + f""",
{ranked_f},
q AS (SELECT {q}),
g AS (SELECT {K}{extra}, {capped} FROM f, q)
SELECT {cols_out} FROM g"""


def _impute_and_cap_sql():
    return _impute_cap_sql(FEATS, f"{K}, {', '.join(FEATS)}")


def clean_paper(spark, sf_dir):
    out = clean.clean_labelled(fx.labelled(spark, sf_dir), profile="paper", keep=KEEP, exact=True,
                               duplicate=("f5", "f0"))
    return out.select(*KEYS, "label", "Attack", *[c for c in FEATS if c in out.columns])


def _clean_paper_sql():
    # f5 duplicates f0 and f4 is constant: both are dropped
    return _impute_cap_sql(FEATS, f"{K}, label, CAST(label <> 'BENIGN' AS INTEGER) AS Attack, f0, f1, f2, f3",
                           ", label", cap=False)


def clean_default(spark, sf_dir):
    out = clean.clean_labelled(fx.labelled(spark, sf_dir), profile="default", mode="full", keep=KEEP, exact=True)
    return out.select(*KEYS, "label", "Attack", *[c for c in FEATS if c in out.columns])


def _clean_default_sql():
    fe = ["f0", "f1", "f2", "f3", "f5"]  # f4 is constant and dropped before the value fixes
    return _impute_cap_sql(fe, f"{K}, label, CAST(label <> 'BENIGN' AS INTEGER) AS Attack, {', '.join(fe)}", ", label")


# -- F4, G1-G4, F8, E2 --------------------------------------------------------------

def seeded_sample_small(spark, sf_dir):
    return split.seeded_sample(_lab(spark, sf_dir), 1000).select(*KEYS, "row_hash")


def seeded_sample_large(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    split_small = split.SMALL_SAMPLE
    try:  # exercise the histogram path at test scale
        split.SMALL_SAMPLE = 1000
        return split.seeded_sample(lab, 30000).select(*KEYS, "row_hash")
    finally:
        split.SMALL_SAMPLE = split_small


def benign_split(spark, sf_dir):
    return split.benign_split(_lab(spark, sf_dir)).select(*KEYS, "label", "part")


def paper_split(spark, sf_dir):
    return split.paper_split(_lab(spark, sf_dir)).select(*KEYS, "label", "test_set")


def _paper_split_cte(with_lab: bool = True):
    head = f"{LAB},\n" if with_lab else ""
    return f"""{head}k AS (SELECT *, {_kind_sql()} AS kind, ({TRAIN_SQL}) AS is_train FROM t),
bt AS (SELECT * FROM k WHERE kind = 'benign' AND NOT is_train),
nn AS (SELECT least((SELECT count(*) FROM k WHERE kind = 'unknown'), (SELECT count(*) FROM bt)) AS m),
ps AS (SELECT {K}, row_hash, label, kind, 'train' AS test_set FROM k WHERE is_train
 UNION ALL SELECT {K}, row_hash, label, kind, 'overall' FROM k WHERE NOT is_train
 UNION ALL SELECT {K}, row_hash, label, kind, 'unknown' FROM (SELECT * FROM bt ORDER BY row_hash LIMIT (SELECT m FROM nn))
 UNION ALL SELECT {K}, row_hash, label, kind, 'unknown' FROM k WHERE kind = 'unknown' AND (SELECT m FROM nn) > 0)"""


def stratified_split(spark, sf_dir):
    return split.stratified_split(_lab(spark, sf_dir), "label").select(*KEYS, "label", "part")


def composition(spark, sf_dir):
    return split.composition(split.paper_split(_lab(spark, sf_dir)), "label", "test_set")


def unknown_rows(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    return split.label_membership(lab, split.unknown_labels(lab), how="left_semi").select(*KEYS, "label")


def known_rows(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    return split.label_membership(lab, split.unknown_labels(lab), how="left_anti").select(*KEYS, "label")


# -- G5-G7 --------------------------------------------------------------------------

SCALE_FEATS = ["f0", "f2", "f3"]


def _train(lab):
    return lab.filter((F.col("label") == "BENIGN") & split.in_fraction(0.8))


def standard_scale(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    sc = fit_standard(_train(lab), SCALE_FEATS)
    z = sc.transform(lab.select(*KEYS, *SCALE_FEATS), suffix="_z")
    return z.select(*KEYS, *[F.round(F.col(f"{c}_z"), 9).alias(f"{c}_z") for c in SCALE_FEATS])


def _standard_scale_sql():
    st = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in SCALE_FEATS)
    z = ", ".join(f"(round(({c} - m_{c}) / s_{c}, 9) + 0.0) AS {c}_z" for c in SCALE_FEATS)
    return f"WITH {LAB}, s AS (SELECT {st} FROM t WHERE {TRAIN_SQL}) SELECT {K}, {z} FROM t, s"


def robust_scale(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    sc = fit_robust(_train(lab), SCALE_FEATS, exact=True)
    z = sc.transform(lab.select(*KEYS, *SCALE_FEATS), suffix="_r")
    return z.select(*KEYS, *[F.round(F.col(f"{c}_r"), 9).alias(f"{c}_r") for c in SCALE_FEATS])


def _robust_scale_sql():
    ranked = ", ".join(_order_cte(f"r_{c}", "tr", c) for c in SCALE_FEATS)
    st = ", ".join(f"{_quantile_sql(f'r_{c}', 0.5)} AS m_{c}, coalesce(nullif({_quantile_sql(f'r_{c}', 0.75)} - "
                   f"{_quantile_sql(f'r_{c}', 0.25)}, 0), 1.0) AS s_{c}" for c in SCALE_FEATS)
    z = ", ".join(f"(round(({c} - m_{c}) / s_{c}, 9) + 0.0) AS {c}_r" for c in SCALE_FEATS)
    return f"WITH {LAB}, tr AS (SELECT * FROM t WHERE {TRAIN_SQL}), {ranked}, s AS (SELECT {st}) SELECT {K}, {z} FROM t, s"


def gamma_scale(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    tr = _train(lab)
    z = fit_standard(tr, SCALE_FEATS).transform(tr.select(*SCALE_FEATS))
    g = gamma_scale_sql_parts(z, SCALE_FEATS)
    return g.select("n", "d", *[F.round(F.col(c), 9).alias(c) for c in ("cell_mean", "cell_var", "gamma_scale", "gamma_auto")])


def _gamma_scale_sql():
    st = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in SCALE_FEATS)
    z = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SCALE_FEATS)
    tot = " + ".join(SCALE_FEATS)
    sq = " + ".join(f"{c} * {c}" for c in SCALE_FEATS)
    d = len(SCALE_FEATS)
    return f"""WITH {LAB}, s AS (SELECT {st} FROM t WHERE {TRAIN_SQL}),
z AS (SELECT {z} FROM t, s WHERE {TRAIN_SQL}),
a AS (SELECT count(*) AS n, sum({tot}) AS s1, sum({sq}) AS s2 FROM z),
b AS (SELECT n, s1 / (CAST(n AS DOUBLE) * {d}.0) AS cm, s2 / (CAST(n AS DOUBLE) * {d}.0) - (s1 / (CAST(n AS DOUBLE) * {d}.0)) * (s1 / (CAST(n AS DOUBLE) * {d}.0)) AS cv FROM a)
SELECT n, {d} AS d, (round(cm, 9) + 0.0) AS cell_mean, (round(cv, 9) + 0.0) AS cell_var, (round(1.0 / ({d}.0 * cv), 9) + 0.0) AS gamma_scale,
 (round(1.0 / {d}.0, 9) + 0.0) AS gamma_auto FROM b"""


# -- G10, G11, G14-G20 with the fixed model recipe (FIXTURES section 4) ----------------

def fixture_model(lab: DataFrame):
    """Scaler on the benign training split; 8 lowest-hash benign rows as support vectors,
    alpha = sv_id / 36, gamma 0.25, rho 0.3 (rbf)."""
    sc = fit_standard(_train(lab), MODEL_FEATS)
    sv = split.seeded_sample(lab.filter(F.col("label") == "BENIGN"), N_SV)
    z = sc.transform(sv.select("row_hash", *MODEL_FEATS))
    from pyspark.sql import Window
    tab = z.select(F.row_number().over(Window.orderBy("row_hash")).alias("sv_id"),
                   F.array(*[F.col(c) for c in MODEL_FEATS]).alias("x")) \
        .withColumn("alpha", F.col("sv_id") / F.lit(36.0))
    return model_from_table(tab, sc, MODEL_FEATS, RHO, "rbf", GAMMA)


def _scored(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    return fixture_model(lab).transform(lab).withColumn("yhat", F.col("is_anomaly").cast("int")) \
        .withColumn("Attack", (F.col("label") != "BENIGN").cast("int"))


def _scored_cte():
    st = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in MODEL_FEATS)
    zz = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in MODEL_FEATS)
    d2 = " + ".join(f"(z.z_{c} - v.z_{c}) * (z.z_{c} - v.z_{c})" for c in MODEL_FEATS)
    return f"""{LAB}, sc AS (SELECT {st} FROM t WHERE {TRAIN_SQL}),
z AS (SELECT t.*, {zz} FROM t, sc),
v AS (SELECT row_number() OVER (ORDER BY row_hash) AS sv_id, * FROM (SELECT * FROM z WHERE label = 'BENIGN' ORDER BY row_hash LIMIT {N_SV})),
ks AS (SELECT z.row_hash,
 sum(v.sv_id / 36.0 * exp(-{GAMMA} * ({d2}))) - {RHO} AS score
 FROM z CROSS JOIN v GROUP BY z.row_hash),
sd AS (SELECT t.*, ks.score, CAST(ks.score <= 0 AS INTEGER) AS yhat, CAST(t.label <> 'BENIGN' AS INTEGER) AS Attack,
 CASE WHEN ks.score <= 0 THEN 'ATTACK' ELSE 'BENIGN' END AS prediction
 FROM t JOIN ks USING (row_hash))"""


def kernel_score(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, F.round("score", 9).alias("score"), "prediction")


def batch_totals(spark, sf_dir):
    return ev.batch_totals(_scored(spark, sf_dir))


def evaluation(spark, sf_dir):
    return ev.evaluate(_scored(spark, sf_dir))


def _eval_cols():
    r = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"
    return (f"tn, fp, fn, tp, {r('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {r('tp', 'tp + fp')} AS precision, "
            f"{r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1_score, "
            f"{r('tn', 'tn + fp')} AS benign_detection_rate, {r('tp', 'tp + fn')} AS attack_detection_rate, "
            f"{r('tn', 'tn + fp')} AS specificity, {r('fp', 'fp + tn')} AS fpr, {r('fn', 'fn + tp')} AS fnr")


CM = ("count(*) FILTER (WHERE Attack = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE Attack = 0 AND yhat = 1) AS fp, "
      "count(*) FILTER (WHERE Attack = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE Attack = 1 AND yhat = 1) AS tp")


def class_report(spark, sf_dir):
    return ev.class_report(ev.confusion(_scored(spark, sf_dir)))


def _class_report_sql():
    r = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"
    return f"""WITH {_scored_cte()}, cm AS (SELECT {CM} FROM sd),
per AS (SELECT 'Benign' AS class, {r('tn', 'tn + fn')} AS precision, {r('tn', 'tn + fp')} AS recall,
  {r('2 * tn', '2 * tn + fn + fp')} AS f1_score, tn + fp AS support FROM cm
 UNION ALL SELECT 'Attack', {r('tp', 'tp + fp')}, {r('tp', 'tp + fn')}, {r('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM cm)
SELECT * FROM per
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per"""


def score_summary(spark, sf_dir):
    s = ev.score_summary(_scored(spark, sf_dir), exact=True)
    return s.select(*[F.round(F.col(c), 9).alias(c) for c in s.columns])


def prediction_distribution(spark, sf_dir):
    return ev.prediction_distribution(_scored(spark, sf_dir))


def eval_by_test_set(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    model = fixture_model(lab)
    sets = split.paper_split(lab).filter(F.col("test_set") != "train")
    scored = model.transform(sets).withColumn("yhat", F.col("is_anomaly").cast("int")) \
        .withColumn("Attack", (F.col("label") != "BENIGN").cast("int"))
    return ev.evaluate(scored, by=["test_set"])


def _alerts(window, slide=None):
    def q(spark, sf_dir):
        from flowlens.streaming.windows import alerts_per_window
        sc = _scored(spark, sf_dir).withColumn("ship_ts", F.to_timestamp("ship_day"))
        return alerts_per_window(sc, "ship_ts", window, slide)
    return q


def _alerts_sql(sliding: bool) -> str:
    day = 86400000000
    if not sliding:
        return f"""WITH {_scored_cte()}, d AS (SELECT epoch_us(CAST(ship_day AS TIMESTAMP)) AS s, yhat FROM sd)
SELECT s AS start_us, s + {day} AS end_us, count(*) AS n_scored, count(*) FILTER (WHERE yhat = 1) AS n_attack FROM d GROUP BY s"""
    return f"""WITH {_scored_cte()}, d AS (SELECT epoch_us(CAST(ship_day AS TIMESTAMP)) AS s, yhat FROM sd),
w AS (SELECT s AS ws, yhat FROM d UNION ALL SELECT s - {day}, yhat FROM d)
SELECT ws AS start_us, ws + {2 * day} AS end_us, count(*) AS n_scored, count(*) FILTER (WHERE yhat = 1) AS n_attack FROM w GROUP BY ws"""


def one_class_fit(spark, sf_dir):
    """G8 (rows-only): fit on the benign training split, score the whole labelled view."""
    lab = _lab(spark, sf_dir)
    model = fit_one_class(_train(lab), MODEL_FEATS, "rbf", "scale", 0.1, n_landmarks=64, iterations=20)
    return model.transform(lab).select(*KEYS, "label", "score", "prediction")


def tuning_results(spark, sf_dir):
    """G13 quick grid (rows-only) on the paper split's overall test set; F6 top 5."""
    lab = _lab(spark, sf_dir)
    ps = split.paper_split(lab)
    train = ps.filter(F.col("test_set") == "train")
    val = ps.filter(F.col("test_set") == "overall").withColumn("Attack", (F.col("label") != "BENIGN").cast("int"))
    res, _best = tune(train, val, MODEL_FEATS, param_grid(spark, quick=True), n_landmarks=32, iterations=8)
    return top_results(res)


def training_run_summary(spark, sf_dir):
    """G21/G22/G9/A9 (rows-only): a full training run in the 'hyperparam' mode."""
    from flowlens.plans.training import run_training
    run = run_training(fx.labelled(spark, sf_dir), features=["f0", "f1", "f2", "f3"], mode="hyperparam",
                       profile="paper", keep=tuple(KEYS + ["ship_day", "file_no"]), n_landmarks=32, iterations=10)
    return run.summary


def model_description(spark, sf_dir):
    """A11 (rows-only): the one-row description of the fixed-recipe model."""
    return fixture_model(_lab(spark, sf_dir)).describe(spark)


def _labelled_csv_files(spark, sf_dir):
    """A7 then A5: the labelled view written as CSV files (by file_no) in the shared
    checkpoint directory, read back as one scan."""
    import os
    from flowlens.session import ensure_checkpoint_dir
    from flowlens.sources.labelled import read_labelled
    src = os.path.join(sf_dir, "lineitem.parquet")
    path = os.path.join(ensure_checkpoint_dir(spark), "fixtures",
                        f"{hashlib.md5(os.path.abspath(src).encode()).hexdigest()[:12]}_{int(os.path.getmtime(src))}", "labelled_csv")
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        (_by_file(fx.labelled(spark, sf_dir)).write.mode("overwrite").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_labelled(spark, [path], label="label",
                         keep_text=("label", "ship_day", "row_hash"))


def labelled_csv_roundtrip(spark, sf_dir):
    df = _labelled_csv_files(spark, sf_dir)
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")],
                     F.col("l_linenumber").cast("int").alias("l_linenumber"), "label", *FEATS)


CAPPED_ROWS = 5_000     # rows_per_file of the "hyperparam" mode


def _by_file(view: DataFrame) -> DataFrame:
    """The view in the order of its files and keys, in ranges that are as many as the input asks for: no task holds a whole file."""
    return view.repartitionByRange(4 * view.rdd.getNumPartitions(), "file_no", *KEYS).sortWithinPartitions("file_no", *KEYS)


def labelled_capped(spark, sf_dir):
    """The first rows of each file, by position. The files are the labelled view by file_no, each in key order."""
    import os
    import uuid
    from flowlens.plans.training import MODES
    from flowlens.session import ensure_checkpoint_dir
    from flowlens.sources.labelled import read_labelled
    assert CAPPED_ROWS == MODES["hyperparam"]["rows_per_file"]
    path = os.path.join(ensure_checkpoint_dir(spark), "fixtures", f"labelled-{uuid.uuid4().hex}")
    view = fx.labelled(spark, sf_dir)
    (_by_file(view).write.partitionBy("file_no").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    files = sorted({f.rsplit("/", 1)[0] for f in spark.read.text(path).inputFiles()})
    df = read_labelled(spark, files, rows_per_file=CAPPED_ROWS, label="label", keep_text=("label", "ship_day", "row_hash"))
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")],
                     F.col("l_linenumber").cast("int").alias("l_linenumber"), "label", *FEATS)


def queries() -> dict:
    return {
        "label_distribution": label_distribution, "distinct_labels": distinct_labels,
        "column_profile": column_profile, "impute_and_cap": impute_and_cap,
        "clean_paper": clean_paper, "clean_default": clean_default,
        "seeded_sample_small": seeded_sample_small, "seeded_sample_large": seeded_sample_large,
        "benign_split": benign_split, "paper_split": paper_split, "stratified_split": stratified_split,
        "composition": composition, "unknown_rows": unknown_rows, "known_rows": known_rows,
        "standard_scale": standard_scale, "robust_scale": robust_scale, "gamma_scale": gamma_scale,
        "kernel_score": kernel_score, "batch_totals": batch_totals, "evaluation": evaluation,
        "class_report": class_report, "score_summary": score_summary,
        "prediction_distribution": prediction_distribution, "eval_by_test_set": eval_by_test_set,
        "one_class_fit": one_class_fit, "tuning_results": tuning_results,
        "alerts_per_day": _alerts("1 day"), "alerts_sliding_2d": _alerts("2 days", "1 day"),
        "training_run_summary": training_run_summary, "model_description": model_description,
        "labelled_csv_roundtrip": labelled_csv_roundtrip, "labelled_capped": labelled_capped,
    }


def oracle() -> dict:
    sc = _scored_cte()
    return {
        "label_distribution": f"WITH {LAB} SELECT label, count(*) AS n FROM t GROUP BY label",
        "distinct_labels": f"WITH {LAB} SELECT DISTINCT label, {_unknown_sql()} AS is_unknown FROM t",
        "column_profile": _column_profile_sql(),
        "impute_and_cap": _impute_and_cap_sql(),
        "clean_paper": _clean_paper_sql(),
        "clean_default": _clean_default_sql(),
        "seeded_sample_small": f"WITH {LAB} SELECT {K}, row_hash FROM t ORDER BY row_hash LIMIT 1000",
        "seeded_sample_large": f"WITH {LAB} SELECT {K}, row_hash FROM t ORDER BY row_hash LIMIT 30000",
        "benign_split": f"WITH {LAB} SELECT {K}, label, CASE WHEN {TRAIN_SQL} THEN 'train' ELSE 'test' END AS part FROM t",
        "paper_split": f"WITH {_paper_split_cte()} SELECT {K}, label, test_set FROM ps",
        "stratified_split": f"""WITH {LAB} SELECT {K}, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY row_hash)
 <= floor(CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) * CAST(0.8 AS DOUBLE) + 0.5) THEN 'train' ELSE 'test' END AS part FROM t""",
        "composition": f"""WITH {_paper_split_cte()}, g AS (SELECT test_set, kind, count(*) AS n FROM ps GROUP BY ALL)
SELECT test_set, kind, n, CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER (PARTITION BY test_set) AS DOUBLE) AS pct FROM g""",
        "unknown_rows": f"WITH {LAB} SELECT {K}, label FROM t WHERE {_unknown_sql()}",
        "known_rows": f"WITH {LAB} SELECT {K}, label FROM t WHERE NOT {_unknown_sql()}",
        "standard_scale": _standard_scale_sql(),
        "robust_scale": _robust_scale_sql(),
        "gamma_scale": _gamma_scale_sql(),
        "kernel_score": f"WITH {sc} SELECT {K}, (round(score, 9) + 0.0) AS score, prediction FROM sd",
        "batch_totals": f"""WITH {sc} SELECT count(*) AS total_flows, count(*) FILTER (WHERE yhat = 0) AS benign_count,
 count(*) FILTER (WHERE yhat = 1) AS attack_count FROM sd""",
        "evaluation": f"WITH {sc}, cm AS (SELECT {CM} FROM sd) SELECT {_eval_cols()} FROM cm",
        "class_report": _class_report_sql(),
        "score_summary": f"""WITH {sc} SELECT (round(min(score), 9) + 0.0) AS score_min, (round(max(score), 9) + 0.0) AS score_max,
 (round(avg(score), 9) + 0.0) AS score_mean, (round(quantile_cont(score, 0.5), 9) + 0.0) AS score_median,
 (round(stddev_pop(score), 9) + 0.0) AS score_std FROM sd""",
        "prediction_distribution": f"WITH {sc} SELECT prediction, count(*) AS n FROM sd GROUP BY prediction",
        "alerts_per_day": _alerts_sql(False), "alerts_sliding_2d": _alerts_sql(True),
        "labelled_csv_roundtrip": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, {', '.join(FEATS)} "
                                  f"FROM ({duckdb_view('labelled')})",
        "labelled_capped": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, {', '.join(FEATS)} "
                           f"FROM ({duckdb_view('labelled')}) QUALIFY row_number() OVER (PARTITION BY file_no "
                           f"ORDER BY {K}) <= {CAPPED_ROWS}",
        "eval_by_test_set": f"""WITH {sc}, {_paper_split_cte(False)},
j AS (SELECT ps.test_set, sd.Attack, sd.yhat FROM ps JOIN sd USING (row_hash) WHERE ps.test_set <> 'train'),
cm AS (SELECT test_set, {CM} FROM j GROUP BY test_set)
SELECT test_set, {_eval_cols()} FROM cm""",
    }
