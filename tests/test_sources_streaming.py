"""Sources, sinks and streaming (stream = batch)."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.operators.assemble import assemble_flows
from flowlens.operators.features import flow_features
from flowlens.operators.records import csv_events_to_features
from flowlens.schemas import FLOW_COLUMNS_82, PACKETS
from flowlens.sources import fixtures as fx
from flowlens.sources.flowcsv import read_flows_csv, write_flows_csv
from flowlens.sources.labelled import read_labelled
from flowlens.sources.packets import ingest_captures
from tests.conftest import SF001


def _pcap(path, packets):
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for ts_us, src, dst, sport, dport, flags, payload in packets:
            ip_total = 20 + 20 + payload
            eth = b"\x00" * 12 + b"\x08\x00"
            ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, ip_total, 0, 0, 64, 6, 0,
                             bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
            tcp = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 1000, 0, 0)
            frame = eth + ip + tcp + b"x" * payload
            f.write(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), len(frame)))
            f.write(frame)


def test_ingest_captures(spark, tmp_path):
    _pcap(tmp_path / "a.pcap", [(1_000_000, "10.0.0.1", "10.0.0.2", 1000, 80, 0x02, 0),
                                (1_100_000, "10.0.0.2", "10.0.0.1", 80, 1000, 0x12, 0),
                                (1_200_000, "10.0.0.1", "10.0.0.2", 1000, 80, 0x18, 10)])
    (tmp_path / "bad.pcap").write_bytes(b"garbage!" * 10)
    packets, errors = ingest_captures(spark, str(tmp_path))
    rows = packets.orderBy("ts_us").collect()
    assert [r["tcp_flags"] for r in rows] == ["S", "SA", "PA"]
    assert rows[2]["payload_len"] == 10 and rows[2]["frame_len"] == 64 and rows[0]["ttl"] == 64
    assert errors.count() == 1
    rec = flow_features(assemble_flows(packets.select(*[f.name for f in PACKETS.fields]))).collect()
    assert len(rec) == 1 and rec[0]["tot_fwd_pkts"] == 2 and rec[0]["syn_flag_cnt"] == 2


@pytest.mark.parametrize("resolution, ticks", [(None, 1_500_000), (9, 1_500_000_000), (0x80 | 10, 1536)])
def test_pcapng_time_resolution(resolution, ticks):
    import struct
    from flowlens.sources.packets import _records_pcapng

    def block(kind, body):
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    options = b"" if resolution is None else struct.pack("<HHB3xHH", 9, 1, resolution, 0, 0)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + options) \
        + block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, 4, 4) + b"abcd")
    assert [(t, f) for t, _, f, _ in _records_pcapng(data)] == [(1_500_000, b"abcd")]


def test_labelled_files_with_their_own_header_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B,Label\n1,2,x\n")
    (tmp_path / "b.csv").write_text("B,A,Label\n20,10,y\n")
    files = [f"file://{tmp_path}/a.csv", str(tmp_path / "b.csv")]
    for kw in ({}, {"rows_per_file": 5}):
        got = read_labelled(spark, files, **kw).select("A", "B", "Label").collect()
        assert sorted(map(tuple, got)) == [(1.0, 2.0, "x"), (10.0, 20.0, "y")]


def test_flow_csv_roundtrip(spark, tmp_path):
    recs = flow_features(assemble_flows(fx.packets(spark, SF001)))
    write_flows_csv(recs, str(tmp_path / "out"))
    back = read_flows_csv(spark, str(tmp_path / "out"))
    feats = csv_events_to_features(back)  # header lines dropped (Q10)
    assert feats.count() == recs.count()
    assert feats.agg(F.sum("Total Fwd Packets")).collect()[0][0] == recs.agg(F.sum("tot_fwd_pkts")).collect()[0][0]


def test_stream_equals_batch(spark, tmp_path):
    from flowlens.streaming.meter import start_metering
    p = fx.packets(spark, SF001)
    last = p.agg(F.max("ts_us")).collect()[0][0]
    sentinel = spark.createDataFrame([(10**12, last + 86_400_000_000, "192.0.2.1", "192.0.2.2", 1, 2, 6, 20, 0, 54, "A", 1)],
                                     PACKETS)
    src = tmp_path / "in"
    p.repartition(4).write.parquet(str(src / "part1"))
    sentinel.write.parquet(str(src / "part2"))
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 2).parquet(str(src / "*"))
    q = start_metering(spark, stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), watermark="10 seconds")
    q.awaitTermination(600)
    got = spark.read.parquet(str(tmp_path / "out" / "flows")).drop("batch_id")
    want = flow_features(assemble_flows(p))
    cols = sorted(want.columns)
    a = sorted(map(tuple, got.select(*cols).collect()))
    b = sorted(map(tuple, want.select(*cols).collect()))
    assert len(a) == len(b) and a == b


def test_end_of_input_closes_every_flow(spark, tmp_path):
    from flowlens.streaming.meter import end_of_input, start_metering
    src, out, ckpt, ctl = (str(tmp_path / d) for d in ("in", "out", "ckpt", "ctl"))
    rows = [(i, 1_000_000_000_000_000 + i * 20_000_000, "10.0.0.1", "10.0.0.2", 1000 + i % 3, 80, 6, 20, 5, 59, "A", 100) for i in range(30)]
    p = spark.createDataFrame(rows, PACKETS)
    p.coalesce(1).write.parquet(src)
    os.mkdir(ctl)
    for last in (False, True):
        if last:
            end_of_input(spark, src, ctl)
        start_metering(spark, spark.readStream.schema(PACKETS).parquet(src), out, ckpt, watermark="10 seconds", control_dir=ctl).awaitTermination(600)
    got = spark.read.parquet(f"{out}/flows").drop("batch_id")
    want = flow_features(assemble_flows(p))
    cols = sorted(want.columns)
    a, b = (sorted(map(tuple, d.select(*cols).collect())) for d in (got, want))
    assert len(a) >= 3 and a == b


def test_csv_scoring_stream_equals_batch(spark, tmp_path):
    """H3 + A4 + A8: CSV files arriving in a directory are scored like the batch path."""
    import numpy as np
    from flowlens.operators.oneclass import OneClassModel
    from flowlens.operators.scale import Scaler
    from flowlens.streaming.meter import start_csv_scoring
    recs = flow_features(assemble_flows(fx.packets(spark, SF001)))
    write_flows_csv(recs.repartition(3), str(tmp_path / "in"))
    feats = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets"]
    sc = Scaler(feats, [100.0, 5.0, 3.0], [50.0, 5.0, 3.0])
    model = OneClassModel(feats, sc, np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]), np.array([0.5, 0.5]), 0.3,
                          "rbf", 0.5)
    q = start_csv_scoring(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                          max_files_per_trigger=1)
    q.awaitTermination(600)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = model.transform(csv_events_to_features(read_flows_csv(spark, str(tmp_path / "in")), features=feats))
    assert got.count() == want.count() == recs.count()
    assert got.filter("is_anomaly").count() == want.filter("is_anomaly").count()


def test_alert_windows_stream(spark, tmp_path):
    """H5 in Structured Streaming: tumbling window counts with a watermark equal the batch ones."""
    from flowlens.streaming.windows import alerts_per_window
    rows = [(i, 1_704_067_200_000_000 + i * 7_000_000, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts_us long, is_anomaly boolean")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")) \
        .withColumn("ts", F.timestamp_micros("ts_us"))
    agg = alerts_per_window(src, "ts", "1 minute", watermark="0 seconds")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("alerts_h5").trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = sorted(map(tuple, spark.sql("SELECT * FROM alerts_h5").collect()))
    want = sorted(map(tuple, alerts_per_window(df.withColumn("ts", F.timestamp_micros("ts_us")), "ts", "1 minute").collect()))
    assert got == want


def test_capture_key_and_ttl(spark, tmp_path):
    """With the capture in the key, a conversation split over two files is two flows;
    D26: initial TTL of the first packet; B4: nested CSV moved up, transport fields dropped."""
    from flowlens.operators.features import flow_initial_ttl
    from flowlens.operators.records import drop_transport_metadata
    pk = [(1_000_000, "10.0.0.1", "10.0.0.2", 1000, 80, 0x02, 0), (1_100_000, "10.0.0.2", "10.0.0.1", 80, 1000, 0x12, 0)]
    _pcap(tmp_path / "a.pcap", pk)
    _pcap(tmp_path / "b.pcap", [(2_000_000, "10.0.0.1", "10.0.0.2", 1000, 80, 0x10, 5)])
    packets, _ = ingest_captures(spark, str(tmp_path))
    merged = assemble_flows(packets)
    separate = assemble_flows(packets, capture_col="capture")
    assert merged.select("flow_pkt").distinct().count() == 1
    assert separate.select("flow_pkt").distinct().count() == 2
    assert [r["init_ttl"] for r in flow_initial_ttl(merged).collect()] == [64]
    ev = spark.createDataFrame([(("a", ["1", "2"]), "x", "h")], "decoded struct<x:string, csv:array<string>>, message string, host string")
    out = drop_transport_metadata(ev)
    assert out.columns == ["csv"] and out.collect()[0]["csv"] == ["1", "2"]


def test_labelled_reader_caps_and_encoding(spark, tmp_path):
    """A5 caps and early stop, A6 latin-1 fallback."""
    from flowlens.sources.labelled import read_labelled, read_labelled_with_fallback
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(" Flow Duration, Label\n" + "".join(f"{j},BENIGN\n" for j in range(10)))
    files = [str(tmp_path / f"f{i}.csv") for i in range(3)] + [str(tmp_path / "missing.csv")]
    assert read_labelled(spark, files).count() == 30
    assert read_labelled(spark, files, rows_per_file=4).count() == 12
    assert read_labelled(spark, files, rows_per_file=4, target_rows=6).count() == 8
    assert dict(read_labelled(spark, files).dtypes)["Flow Duration"] == "double"
    (tmp_path / "lat.csv").write_bytes("Flow Duration,Label\n1,Caf\xe9\n".encode("latin-1"))
    df = read_labelled_with_fallback(spark, [str(tmp_path / "lat.csv"), str(tmp_path / "f0.csv")])
    assert "Café" in {r["Label"] for r in df.collect()}
