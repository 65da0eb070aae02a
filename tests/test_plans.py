"""Physical-plan checks: pushdown and pruning reach the scan; no extra shuffles."""

from flowlens.operators.assemble import assemble_flows, flow_sessions
from flowlens.operators.features import flow_features
from flowlens.sources import fixtures as fx
from flowlens.sources.packets import read_packets
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushdown_and_pruning(spark, tmp_path):
    fx.packets(spark, SF001).write.parquet(str(tmp_path / "packets"))
    p = read_packets(spark, str(tmp_path / "packets"))
    plan = _plan(flow_sessions(assemble_flows(p, long_flow_cut=False)))
    assert "PushedFilters: [In(protocol, [17,6])]" in plan or "PushedFilters: [In(protocol, [6,17])]" in plan
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and all("tcp_window" not in s and "ip_hdr_len" not in s for s in scans)


def test_flagship_plan_shape(spark):
    df = flow_features(assemble_flows(fx.packets(spark, SF001)))
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # the pass over packets that cuts flows has two readers, composition and walk, and Spark plans it for each of them
    passes = [line for line in plan.split("\n") if "MapInArrow" in line and "exit_us#" in line and "pkt#" in line.split("[", 1)[-1]]
    assert 1 <= len(passes) <= 2
    assert "MapInPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucketed_scan_reads_materialised_input(spark):
    plan = _plan(flow_features(assemble_flows(fx.packets(spark, SF001)), bucket_us=1_000_000))
    assert "MapInPandas" not in plan  # the cut ran once, before the table was written
