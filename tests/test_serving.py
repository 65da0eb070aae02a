"""Requests, CSV lines and the scoring stream: identity, rejects, odd rows."""

import json

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import records as R
from flowlens.operators.evaluate import batch_totals
from flowlens.operators.oneclass import OneClassModel
from flowlens.operators.scale import Scaler
from flowlens.schemas import FLOW_COLUMNS_82, PACKETS

FEATS = ["Flow Duration", "Total Fwd Packets"]


def test_requests_are_read_or_rejected_with_a_reason(spark):
    rows = [(1, '{" Flow Duration ": 1.5, "Other": 2}'), (2, '{"Flow Duration": "2.5"}'), (3, "{}"), (4, '{"Flow Duration": "Infinity", "Total Fwd Packets": 1e300}'),
            (5, '{"Flow Duration": 1'), (6, "[1]"), (7, None), (8, ""), (9, '{"Flow Duration": "x"}'), (10, '{"Flow Duration": null}'),
            (11, '{"Flow Duration": 1, "Flow Duration ": 1}'), (12, '{"a": {"b": 1}}')]
    df = spark.createDataFrame(rows, "id long, body string")
    good, bad = R.split_requests(df, "body")
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        5: "no object of names and numbers", 6: "no object of names and numbers", 7: "no object of names and numbers", 8: "no object of names and numbers",
        9: "a value is no number", 10: "a value is no number", 11: "a name stands there twice", 12: "a value is no number"}
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3, 4]
    got = {r["id"]: (r["Flow Duration"], r["Total Fwd Packets"]) for r in R.request_map_to_features(df, "body", ["id"], FEATS).collect()}
    assert got == {1: (1.5, 0.0), 2: (2.5, 0.0), 3: (0.0, 0.0), 4: (0.0, 1e300)}
    assert R.request_map_to_features(df.limit(0), "body", ["id"], FEATS).count() == 0


def test_batch_requests_are_counted_and_rejected_as_a_whole(spark):
    one = lambda d, n: {"Flow Duration": d, "Total Fwd Packets": n}
    rows = [("a", json.dumps([one(0, 0), one(50, 50), one(0.1, 0)])), ("b", "[]"), ("c", json.dumps([one(1, 1), {"Flow Duration": "no"}])), ("d", "not json"), ("e", None)]
    good, bad = R.explode_batch_request(spark.createDataFrame(rows, "req string, flows string"), "flows")
    assert {r["req"]: r["reason"] for r in bad.collect()} == {"c": "a value is no number", "d": "no list of objects", "e": "no list of objects"}
    assert sorted((r["req"], r["flow_idx"]) for r in good.collect()) == [("a", 0), ("a", 1), ("a", 2)]
    model = OneClassModel(FEATS, Scaler(FEATS, [0.0, 0.0], [1.0, 1.0]), np.zeros((1, 2)), np.ones(1), 0.5, "rbf", 0.5)
    scored = model.transform(R.request_map_to_features(good, "request", ["req"], FEATS))
    assert [tuple(r) for r in batch_totals(scored, ["req"]).collect()] == [("a", 3, 2, 1)]
    assert tuple(batch_totals(scored).first()) == (3, 2, 1)


def test_csv_lines(spark):
    rows = ['a,b,c', '"a,b",c', '"a ""q""",', '', 'a,"b', '"",""', ' a , b', None, 'x"y"z,1', '"']
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "id long, l string").orderBy("id").select(R.decode_csv_line(F.col("l"))).collect()]
    assert got == [["a", "b", "c"], ["a,b", "c"], ['a "q"', ""], [""], None, ["", ""], [" a ", " b"], None, ['x"y"z', "1"], None]
    df = spark.createDataFrame([(k, line) for k, line in enumerate(rows)], "id long, l string").withColumn("csv", R.decode_csv_line(F.col("l")))
    ok, rejected = R.split_by_width(df, widths=(2,))
    assert ok.count() + rejected.count() == len(rows) and rejected.where("csv is null").count() == 3


def test_scoring_stream_keeps_identity_and_rejects(spark, tmp_path):
    from flowlens.streaming.meter import start_csv_scoring
    line = ["10.0.0.9", "10.0.0.1", "4000", "80", "6", "2024-03-05 10:00:00"] + [str(k) for k in range(76)]
    quoted = ['"10.0.0.8"', *line[1:]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(FLOW_COLUMNS_82), ",".join(line), ",".join(quoted), ",".join(line[:81]), 'broken "'] ) + "\n")
    model = OneClassModel(FEATS, Scaler(FEATS, [0.0, 0.0], [1.0, 1.0]), np.zeros((1, 2)), np.ones(1), 0.5, "rbf", 0.5)
    start_csv_scoring(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["dst_port"], r["timestamp"], r["prediction"], str(r["date"])) for r in got] == [
        ("10.0.0.8", "80", line[5], "attack", "2024-03-05"), ("10.0.0.9", "80", line[5], "attack", "2024-03-05")]
    assert all(r["source_file"].endswith("a.csv") for r in got)
    assert spark.read.parquet(str(tmp_path / "out_rejected")).count() == 2


def test_metering_stream_takes_packets_without_address_or_port(spark, tmp_path):
    from flowlens.operators.assemble import assemble_flows
    from flowlens.operators.features import flow_features
    from flowlens.streaming.meter import end_of_input, start_metering
    src, out, ckpt, ctl = (str(tmp_path / d) for d in ("in", "out", "ckpt", "ctl"))
    t0 = 1_000_000_000_000_000
    rows = [(k, t0 + k * 1_000_000, None if k % 2 else "10.0.0.1", "10.0.0.2", None if k % 3 else 5, 80, 6, 20, 5, 59, "A" if k % 4 else None, 100) for k in range(12)]
    p = spark.createDataFrame(rows, PACKETS)
    p.coalesce(1).write.parquet(src)
    (tmp_path / "ctl").mkdir()
    before = spark.read.parquet(src).count()
    for last in (False, True):
        if last:
            end_of_input(spark, src, ctl)
        start_metering(spark, spark.readStream.schema(PACKETS).parquet(src), out, ckpt, watermark="10 seconds", control_dir=ctl).awaitTermination(300)
    assert spark.read.parquet(src).count() == before              # the marker is not among the packets
    got, want = spark.read.parquet(f"{out}/flows").drop("batch_id"), flow_features(assemble_flows(p))
    cols = sorted(want.columns)
    a, b = (sorted(map(repr, d.select(*cols).collect())) for d in (got, want))
    assert a == b and len(a) >= 2
