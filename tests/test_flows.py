"""Flow metering: the reference's unit cases, hand-computed edge cases and invariances."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators.assemble import assemble_flows, flow_sessions
from flowlens.operators.features import flow_features
from flowlens.schemas import PACKETS, FLOW_COLUMNS_82

T0 = 1_704_067_200_000_000


def pk(seq, t_us, src, dst, sport, dport, proto=6, payload=0, flags="A", window=100, hdr=20):
    frame = 14 + hdr + (20 if proto == 6 else 8) + payload
    return (seq, T0 + t_us, src, dst, sport, dport, proto, hdr, payload, frame, flags if proto == 6 else "", window)


def df(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def features(spark, rows, **kw):
    return {r["flow_pkt"]: r.asDict() for r in flow_features(assemble_flows(df(spark, rows), **kw)).collect()}


def mock_packets():
    # six packets 0.1 s apart: 2 TCP forward, 2 TCP back, 1 ICMP, 1 UDP (reference unit test)
    a, b = "192.168.1.2", "192.168.1.1"
    return [pk(0, 0, a, b, 12345, 80), pk(1, 100_000, a, b, 12345, 80),
            pk(2, 200_000, b, a, 80, 12345), pk(3, 300_000, b, a, 80, 12345),
            pk(4, 400_000, a, b, 0, 0, proto=1), pk(5, 500_000, a, b, 12346, 53, proto=17)]


def test_reference_unit_flow(spark):
    recs = features(spark, mock_packets())
    assert set(recs) == {0, 5}  # ICMP rejected, TCP and UDP flows kept
    r = recs[0]
    assert set(FLOW_COLUMNS_82) <= set(r)
    assert 0.29 <= r["flow_duration"] <= 0.31
    assert (r["tot_fwd_pkts"], r["tot_bwd_pkts"]) == (2, 2)
    assert 13.0 <= r["flow_pkts_s"] <= 13.5
    assert r["protocol"] == 6 and recs[5]["protocol"] == 17
    assert (r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"]) == ("192.168.1.2", 12345, "192.168.1.1", 80)


def test_key_symmetric(spark):
    rows = mock_packets()[:4]
    rev = [(s, t, d, sr, dp, sp, *rest) for (s, t, sr, d, sp, dp, *rest) in rows]
    a = flow_sessions(assemble_flows(df(spark, rows))).collect()
    b = flow_sessions(assemble_flows(df(spark, rev))).collect()
    assert len(a) == len(b) == 1 and a[0]["n_pkts"] == b[0]["n_pkts"] == 4


def test_idle_gap_edges(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [pk(0, 0, a, b, 1, 2), pk(1, 240_000_000, a, b, 1, 2),          # exactly 240 s: same flow
            pk(2, 480_000_001, a, b, 1, 2)]                                  # 240 s + 1 us: new flow
    s = flow_sessions(assemble_flows(df(spark, rows), long_flow_cut=False)).orderBy("first_us").collect()
    assert [r["n_pkts"] for r in s] == [2, 1]


def test_long_flow_cut_edges(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [pk(0, 0, a, b, 1, 2), pk(1, 120_000_000, a, b, 1, 2),  # duration exactly 120 s stays open
            pk(2, 120_000_001, a, b, 1, 2),                         # 120 s + 1 us closes, as the last packet
            pk(3, 130_000_000, a, b, 1, 2)]
    s = flow_sessions(assemble_flows(df(spark, rows))).orderBy("first_us").collect()
    assert [r["n_pkts"] for r in s] == [3, 1]


def test_fin_close(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [pk(0, 0, a, b, 1, 2), pk(1, 89_999_999, a, b, 1, 2, flags="FA"),  # FIN before 90 s: no close
            pk(2, 90_000_000, b, a, 2, 1, flags="FA"),                           # FIN at 90 s closes
            pk(3, 91_000_000, b, a, 2, 1)]
    s = flow_sessions(assemble_flows(df(spark, rows))).orderBy("first_us").collect()
    assert [r["n_pkts"] for r in s] == [3, 1]
    assert s[1]["src_ip"] == b  # orientation re-decided for the new flow
    off = flow_sessions(assemble_flows(df(spark, rows), fin_close=False)).collect()
    assert len(off) == 1


def test_bulk_runs(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    t = iter(range(0, 10_000_000, 100_000))
    rows, seq = [], iter(range(100))
    for _ in range(3):  # run of 3: no bulk
        rows.append(pk(next(seq), next(t), a, b, 1, 2, payload=10))
    rows.append(pk(next(seq), next(t), b, a, 2, 1, payload=5))  # breaks the forward run
    for _ in range(5):  # run of 5 forward: one bulk of 5 packets, 50 bytes
        rows.append(pk(next(seq), next(t), a, b, 1, 2, payload=10))
    rows.append(pk(next(seq), next(t), a, b, 1, 2, payload=0))  # zero payload is skipped
    r = list(features(spark, rows).values())[0]
    assert r["fwd_pkts_b_avg"] == 5.0 and r["fwd_byts_b_avg"] == 50.0
    assert r["fwd_blk_rate_avg"] == pytest.approx(50 / 0.4)
    assert r["bwd_pkts_b_avg"] == 0.0


def test_one_packet_flow_and_equal_timestamps(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    r = list(features(spark, [pk(0, 0, a, b, 1, 2)]).values())[0]
    assert r["flow_duration"] == 0.0 and r["flow_byts_s"] == 0.0 and r["flow_iat_mean"] == 0.0
    rows = [pk(0, 5, a, b, 1, 2), pk(1, 5, b, a, 2, 1), pk(2, 5, a, b, 1, 2)]
    r = list(features(spark, rows).values())[0]
    assert (r["tot_fwd_pkts"], r["tot_bwd_pkts"]) == (2, 1) and r["flow_duration"] == 0.0


def test_out_of_order_input(spark):
    rows = mock_packets()[:4]
    a = features(spark, rows)
    b = features(spark, list(reversed(rows)))
    assert a == b


def test_first_packet_weight_two(spark):
    rows = mock_packets()[:4]
    r = list(features(spark, rows, first_packet_weight=2).values())[0]
    assert r["tot_fwd_pkts"] == 3 and r["flow_iat_min"] == 0.0  # first packet counted twice


def test_partitioning_invariance(spark):
    from flowlens.sources import fixtures as fx
    from tests.conftest import SF001
    p = fx.packets(spark, SF001)
    base = sorted(map(tuple, flow_features(assemble_flows(p)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            shuffled = p.orderBy(F.rand(7)).repartition(int(n) + 1)
            assert sorted(map(tuple, flow_features(assemble_flows(shuffled)).collect())) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cut_state_across_arrow_batches(spark):
    from flowlens.sources import fixtures as fx
    from tests.conftest import SF001
    p = fx.packets(spark, SF001)
    base = sorted(map(tuple, flow_sessions(assemble_flows(p)).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, flow_sessions(assemble_flows(p)).collect())) == base
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_bucket_width_invariance(spark):
    from flowlens.sources import fixtures as fx
    from tests.conftest import SF001
    a = assemble_flows(fx.packets(spark, SF001))
    base = sorted(map(tuple, flow_features(a).collect()))
    for width in (1_000, 1_000_000, 50_000_000, 10**15):
        assert sorted(map(tuple, flow_features(a, bucket_us=width).collect())) == base


@pytest.mark.parametrize("cut", [True, False])
def test_packets_without_address_or_port_are_kept(spark, cut):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [pk(0, 0, a, b, 1, 2), pk(1, 10, None, b, 5, 6), pk(2, 20, b, None, 6, 5), pk(3, 30, a, b, None, 9), pk(4, 300_000_000, a, b, None, 9)]
    got = {r["pkt_seq"]: (r["flow_pkt"], r["is_fwd"]) for r in assemble_flows(df(spark, rows), long_flow_cut=cut).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
