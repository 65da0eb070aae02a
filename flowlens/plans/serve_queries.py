"""Registered serving-side queries (E-2) over the flow-CSV view, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import records as R
from flowlens.schemas import FEATURE_NAME_MAP, FLOW_COLUMNS_80, FLOW_COLUMNS_82, MODEL_FEATURES_DEFAULT
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures import duckdb_view
from flowlens.sources.io import materialize

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)
CSV = f"c AS ({duckdb_view('flow_csv')})"


def csv_to_features(spark, sf_dir):
    return R.csv_events_to_features(fx.flow_csv(spark, sf_dir), keep=KEYS)


def _features_sql(source: str) -> str:
    """Accepted rows (width 80/82, not a header) -> 77 model features."""
    idx82 = {n: i + 1 for i, n in enumerate(FLOW_COLUMNS_82)}
    idx80 = {n: i + 1 for i, n in enumerate(FLOW_COLUMNS_80)}
    cols = []
    for f in MODEL_FEATURES_DEFAULT:
        src = {v: k for k, v in FEATURE_NAME_MAP.items()}[f]
        raw = f"CASE WHEN len(csv) = 82 THEN csv[{idx82[src]}] ELSE csv[{idx80[src]}] END"
        x = f"coalesce(TRY_CAST({raw} AS DOUBLE), 0.0)"
        cols.append(f"CASE WHEN isnan({x}) OR abs({x}) = 'Infinity'::DOUBLE THEN 0.0 ELSE {x} END AS \"{f}\"")
    return (f"WITH {CSV} SELECT {K}, {', '.join(cols)} FROM {source} "
            f"WHERE len(csv) IN (80, 82) AND (trim(csv[1]) NOT IN ('src_ip', 'src_port') OR csv[1] IS NULL)")


def csv_width_rejects(spark, sf_dir):
    _, rej = R.split_by_width(fx.flow_csv(spark, sf_dir))
    return rej.select(*KEYS, F.size("csv").alias("width"))


def scoring_requests(spark, sf_dir):
    """A10: each accepted CSV event becomes a JSON request map (S12), is parsed back and
    mapped onto the model features (B8/B9)."""
    feats = R.csv_events_to_features(fx.flow_csv(spark, sf_dir), keep=KEYS)
    # a struct is written as the same JSON object as a map, without a map of 77 names for every row
    req = feats.select(*KEYS, F.to_json(F.struct(*[F.col(f"`{f}`") for f in MODEL_FEATURES_DEFAULT])).alias("request"))
    return R.request_map_to_features(req, "request", keep=KEYS)


# G12 end to end with a fixed recipe: standard scaler over all accepted events, the 8
# events with the lowest keys as support vectors, alpha = sv_id / 36, gamma 0.25, rho 0.3.
CSV_MODEL_FEATS = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets"]


def _csv_model(feats):
    from pyspark.sql import Window
    from flowlens.operators.oneclass import model_from_table
    from flowlens.operators.scale import fit_standard
    sc = fit_standard(feats, CSV_MODEL_FEATS)
    sv = sc.transform(feats.orderBy(*KEYS).limit(8))
    tab = sv.select(F.row_number().over(Window.orderBy(*KEYS)).alias("sv_id"),
                    F.array(*[F.col(f"`{c}`") for c in CSV_MODEL_FEATS]).alias("x")) \
        .withColumn("alpha", F.col("sv_id") / F.lit(36.0))
    return model_from_table(tab, sc, CSV_MODEL_FEATS, 0.3, "rbf", 0.25)


def csv_score(spark, sf_dir):
    feats = materialize(R.csv_events_to_features(fx.flow_csv(spark, sf_dir), keep=KEYS, features=CSV_MODEL_FEATS), "features")
    scored = R.csv_prediction(_csv_model(feats).transform(feats))
    return scored.select(*KEYS, F.round("score", 9).alias("score"), "prediction")


def csv_score_with_identity(spark, sf_dir):
    """Every scored row says which flow it is about."""
    feats = materialize(R.csv_events_to_features(fx.flow_csv(spark, sf_dir), keep=[*KEYS, *R.IDENTITY], features=CSV_MODEL_FEATS), "features")
    scored = R.csv_prediction(_csv_model(feats).transform(feats))
    return scored.select(*KEYS, *R.IDENTITY, F.round("score", 9).alias("score"), "prediction")


def batch_requests(spark, sf_dir):
    """A10 + G11: the events of an order as one JSON list; every list is scored and counted."""
    from flowlens.operators.evaluate import batch_totals
    feats = materialize(R.csv_events_to_features(fx.flow_csv(spark, sf_dir), keep=KEYS, features=CSV_MODEL_FEATS), "features")
    one = F.to_json(F.create_map(*[x for f in CSV_MODEL_FEATS for x in (F.lit(f" {f}"), F.col(f"`{f}`"))]))
    requests = feats.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("flows"))
    rows, _ = R.explode_batch_request(requests, "flows")
    scored = _csv_model(feats).transform(R.request_map_to_features(rows, "request", keep=["l_orderkey"], features=CSV_MODEL_FEATS))
    return batch_totals(scored, ["l_orderkey"])


def _batch_requests_sql() -> str:
    return (f"SELECT l_orderkey, count(*) AS total_flows, count(*) FILTER (prediction = 'benign') AS benign_count, "
            f"count(*) FILTER (prediction = 'attack') AS attack_count FROM ({_csv_score_sql()}) GROUP BY l_orderkey")


def bad_requests(spark, sf_dir):
    """A10: requests that can't be scored, each with its reason."""
    return R.split_requests(fx.requests(spark, sf_dir), "request")[1].select(*KEYS, "reason")


def good_requests(spark, sf_dir):
    """A10: the others, as features."""
    return R.request_map_to_features(fx.requests(spark, sf_dir), "request", keep=KEYS, features=CSV_MODEL_FEATS)


def flows_csv_text(spark, sf_dir):
    """A3: lines of text, some of them headers, quoted or broken, to records."""
    lines = R.decode_lines(fx.flow_lines(spark, sf_dir), "line")
    ok, _ = R.split_by_width(R.drop_header_rows(lines))
    return R.csv_to_record(ok, keep=KEYS).select(*KEYS, "src_port", "timestamp", "flow_duration", "tot_fwd_pkts", "subflow_bwd_byts")


def _flows_csv_text_sql() -> str:
    field = lambda n: f"CASE WHEN len(csv) = 82 THEN csv[{FLOW_COLUMNS_82.index(n) + 1}] ELSE csv[{FLOW_COLUMNS_80.index(n) + 1}] END"
    read = ", ".join(f"""CASE WHEN {field(n)} = 'bad' THEN 'b"a,d' ELSE {field(n)} END AS {n}"""
                     for n in ("src_port", "timestamp", "flow_duration", "tot_fwd_pkts", "subflow_bwd_byts"))
    return f"WITH {CSV} SELECT {K}, {read} FROM c WHERE len(csv) IN (80, 82) AND l_orderkey % 101 <> 0 AND l_orderkey % 103 <> 0"


def _csv_score_sql() -> str:
    q = [f'"{c}"' for c in CSV_MODEL_FEATS]
    st = ", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s{i}" for i, c in enumerate(q))
    z = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(q))
    d2 = " + ".join(f"(z.z{i} - v.z{i}) * (z.z{i} - v.z{i})" for i in range(len(q)))
    feats = _features_sql("c").replace(f"WITH {CSV} ", "")
    return f"""WITH {CSV}, fe AS ({feats}),
sc AS (SELECT {st} FROM fe),
z AS (SELECT row_number() OVER () AS rid, {K}, {z} FROM fe, sc),
v AS (SELECT row_number() OVER (ORDER BY {K}) AS sv_id, * EXCLUDE (rid) FROM (SELECT * FROM z ORDER BY {K} LIMIT 8)),
ks AS (SELECT z.rid, any_value(z.l_orderkey) AS l_orderkey, any_value(z.l_linenumber) AS l_linenumber,
 any_value(z.l_partkey) AS l_partkey, any_value(z.l_suppkey) AS l_suppkey,
 sum(v.sv_id / 36.0 * exp(-0.25 * ({d2}))) - 0.3 AS score FROM z CROSS JOIN v GROUP BY z.rid)
SELECT {K}, (round(score, 9) + 0.0) AS score, CASE WHEN score <= 0 THEN 'attack' ELSE 'benign' END AS prediction FROM ks"""


def _identity_sql() -> str:
    cols = ", ".join(f"CASE WHEN len(csv) = 82 THEN csv[{FLOW_COLUMNS_82.index(n) + 1}] ELSE "
                     f"{'NULL' if n not in FLOW_COLUMNS_80 else f'csv[{FLOW_COLUMNS_80.index(n) + 1}]'} END AS {n}" for n in R.IDENTITY)
    return f"WITH {CSV} SELECT DISTINCT {K}, {cols} FROM c"          # rows with one key are alike


def queries() -> dict:
    return {"csv_to_features": csv_to_features, "csv_width_rejects": csv_width_rejects,
            "scoring_requests": scoring_requests, "csv_score": csv_score, "csv_score_with_identity": csv_score_with_identity,
            "batch_requests": batch_requests, "bad_requests": bad_requests, "good_requests": good_requests, "flows_csv_text": flows_csv_text}


def oracle() -> dict:
    return {
        "csv_to_features": _features_sql("c"),
        "csv_width_rejects": f"WITH {CSV} SELECT {K}, CAST(len(csv) AS INTEGER) AS width FROM c WHERE len(csv) NOT IN (80, 82)",
        "scoring_requests": _features_sql("c"),
        "csv_score": _csv_score_sql(),
        "csv_score_with_identity": f"SELECT s.*, {', '.join(R.IDENTITY)} FROM ({_csv_score_sql()}) s JOIN ({_identity_sql()}) i USING ({K})",
        "batch_requests": _batch_requests_sql(),
        "bad_requests": f"SELECT {K}, reason FROM ({duckdb_view('requests')}) WHERE reason IS NOT NULL",
        "good_requests": (f"SELECT {K}, duration AS \"Flow Duration\", fwd AS \"Total Fwd Packets\", 0.0::DOUBLE AS \"Total Backward Packets\" "
                          f"FROM ({duckdb_view('requests')}) WHERE reason IS NULL"),
        "flows_csv_text": _flows_csv_text_sql(),
    }
