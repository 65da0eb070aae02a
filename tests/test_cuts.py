"""C4/C5 by composition, and the identity of flows over captures."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators.assemble import FLOW_ID, assemble_flows, cut_long_flows, flow_sessions, idle_sessions, with_flow_key
from flowlens.operators.cuts import flow_starts
from flowlens.operators.features import flow_features
from flowlens.schemas import PACKETS
from flowlens.sources.flowcsv import write_flows_csv
from tests.test_flows import T0, pk

S = 1_000_000


def brute(packets, long_us, fin_us, fin_close):
    """First packets of the flows of one session, one packet after the other."""
    out, start, closed = [], None, True
    for ts, seq, fin in sorted(packets):
        if closed:
            out.append((ts, seq))
            start, closed = ts, False
        elif ts - start > long_us or (fin_close and fin and ts - start >= fin_us):
            closed = True
    return out


@pytest.mark.parametrize(("segment", "group", "fin_close"), [(200, 2, True), (200, 3, False), (50, 2, True), (900, 64, True), (130, 1, True)])
def test_composed_cuts_match_one_pass(spark, segment, group, fin_close):
    rng = random.Random(segment)
    rows, want = [], set()
    for s in range(30):
        gap = rng.choice([1, 7, 40, 100, 200])
        ts, own = rng.randint(0, 500 * S), []
        for k in range(rng.choice([1, 3, 60, 300])):
            own.append((ts, k, rng.random() < rng.choice([0, 0.05, 0.5])))
            ts += rng.choice([0, gap * S, rng.randint(0, 2 * gap * S)])
        first = min(own)[0]
        rows += [(s, -s, first, t, k, f"ip{k % 3}" if k % 5 else None, k if k % 4 else None, fin) for t, k, fin in own]
        want |= {(s, t, k, f"ip{k % 3}" if k % 5 else None, k if k % 4 else None) for t, k in brute(own, 120 * S, 90 * S, fin_close)}
    df = spark.createDataFrame(rows, "s1 long, s2 long, sess_us long, ts_us long, pkt_seq long, src_ip string, src_port long, fin boolean").repartition(3)
    got = [(r["s1"], r["flow_us"], r["flow_pkt"], r["flow_ip"], r["flow_port"])
           for r in flow_starts(df, 120 * S, 90 * S if fin_close else 120 * S, fin_close, 400 * S, segment * S, group).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_session_that_never_falls_idle_is_dealt_out(spark):
    n = 40_000
    rows = [pk(k, k * S // 2, "10.0.0.1", "10.0.0.2", 1, 2, flags="FA" if k % 999 == 0 else "A") for k in range(n)]
    rows += [pk(n + k, k * S, "10.0.1.%d" % (k % 200), "10.0.0.2", k % 1000, 2) for k in range(n // 4)]
    packets = with_flow_key(spark.createDataFrame(rows, PACKETS))
    key = ["lo_ip", "lo_port", "hi_ip", "hi_port"]
    sessions = idle_sessions(packets, key)
    hot = sessions.where("hi_ip = '10.0.0.2' and lo_ip = '10.0.0.1'").withColumn("seg", F.floor(F.col("ts_us") / F.lit(900 * S)))
    dealt = hot.groupBy("seg").count().toPandas()["count"]
    assert dealt.sum() == n and dealt.max() <= 2 * dealt.median()        # what one task of the pass has to read
    flows = cut_long_flows(sessions, key).where("lo_ip = '10.0.0.1'")
    want = brute([(T0 + k * S // 2, k, k % 999 == 0) for k in range(n)], 120 * S, 90 * S, True)
    assert sorted((r[0], r[1]) for r in flows.select("flow_us", "flow_pkt").distinct().collect()) == want
    plan = cut_long_flows(sessions, key)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_captures_that_count_from_zero_stay_apart(spark, tmp_path):
    a, b, c = "10.0.0.1", "10.0.0.2", "10.0.0.3"
    one = [pk(0, 0, a, b, 1, 2), pk(1, 10 * S, b, a, 2, 1)]
    two = [pk(0, 0, a, c, 5, 6), pk(1, 10 * S, c, a, 6, 5), pk(2, 20 * S, a, b, 1, 2)]
    df = spark.createDataFrame(one, PACKETS).withColumn("capture", F.lit("x")).unionAll(spark.createDataFrame(two, PACKETS).withColumn("capture", F.lit("y")))
    merged = flow_sessions(assemble_flows(df)).collect()
    assert sorted((r["dst_ip"], r["n_pkts"]) for r in merged) == [(b, 3), (c, 2)]
    rec = flow_features(assemble_flows(df, capture_col="capture"))
    assert sorted((r["capture"], r["dst_ip"], r["tot_fwd_pkts"]) for r in rec.collect()) == [("x", b, 1), ("y", b, 1), ("y", c, 1)]
    again = assemble_flows(df.repartition(5), capture_col="capture")
    ids = {tuple(r) for r in rec.select(*FLOW_ID).collect()}
    assert len(ids) == 3 and ids == {tuple(r) for r in again.select(*FLOW_ID).distinct().collect()}
    write_flows_csv(rec, str(tmp_path / "out"), per_capture="capture")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["capture=x", "capture=y"]
