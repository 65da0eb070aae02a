"""Event-time windows that run unchanged in batch and in Structured Streaming (H2, H5).

Both are single declarative aggregations: Spark keeps constant-size state per window
(counts and sums) and, with a watermark, drops late rows and finalises windows in
append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.assemble import KEY, tcp_udp_only, with_flow_key
from flowlens.schemas import IDLE_TIMEOUT_US


def session_flows(packets: DataFrame, gap_us: int = IDLE_TIMEOUT_US, watermark: str | None = None) -> DataFrame:
    """H2: idle-split flows (R1 only) as ``session_window`` aggregates with D1-D4.

    Direction is resolved inside the one aggregation: traffic is summed per endpoint of
    the unordered key and the forward endpoint is the source of the first packet."""
    p = with_flow_key(tcp_udp_only(packets)).withColumn("ts", F.timestamp_micros("ts_us"))
    if watermark:
        p = p.withWatermark("ts", watermark)
    from_lo = (F.col("src_ip") == F.col("lo_ip")) & (F.col("src_port") == F.col("lo_port"))
    g = p.groupBy(*KEY, F.session_window("ts", f"{gap_us // 1_000_000} seconds").alias("sw")).agg(
        F.min_by(from_lo, F.struct("ts_us", "pkt_seq")).alias("first_lo"),
        F.count(F.when(from_lo, 1)).alias("n_lo"), F.count(F.when(~from_lo, 1)).alias("n_hi"),
        F.coalesce(F.sum(F.when(from_lo, F.col("frame_len"))), F.lit(0).cast("long")).alias("b_lo"),
        F.coalesce(F.sum(F.when(~from_lo, F.col("frame_len"))), F.lit(0).cast("long")).alias("b_hi"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    lo = F.col("first_lo")
    return g.select(
        *KEY, F.unix_micros(F.col("sw.start")).alias("start_us"), F.unix_micros(F.col("sw.end")).alias("end_us"),
        F.when(lo, F.col("n_lo")).otherwise(F.col("n_hi")).alias("tot_fwd_pkts"),
        F.when(lo, F.col("n_hi")).otherwise(F.col("n_lo")).alias("tot_bwd_pkts"),
        F.when(lo, F.col("b_lo")).otherwise(F.col("b_hi")).alias("totlen_fwd_pkts"),
        F.when(lo, F.col("b_hi")).otherwise(F.col("b_lo")).alias("totlen_bwd_pkts"),
        ((F.col("last_us") - F.col("first_us")).cast("double") / 1_000_000.0).alias("flow_duration"))


def alerts_per_window(scored: DataFrame, time_col: str, window: str = "1 minute", slide: str | None = None,
                      watermark: str | None = None) -> DataFrame:
    """H5: per event-time window, scored rows and attack predictions (tumbling, or sliding
    with ``slide``)."""
    s = scored.withWatermark(time_col, watermark) if watermark else scored
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return s.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count(F.when(F.col("is_anomaly"), 1)).alias("n_attack")) \
        .select(F.unix_micros(F.col("w.start")).alias("start_us"), F.unix_micros(F.col("w.end")).alias("end_us"),
                "n_scored", "n_attack")
