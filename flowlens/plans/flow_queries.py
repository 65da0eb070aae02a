"""Registered flow-metering queries (E-1): packets view -> flows -> feature subsets.

Each query is ``(spark, sf_dir) -> DataFrame`` over the whole packets view; the matching
DuckDB text comes from ``flowlens.oracle``. Subset queries select from the one 82-field
record; Catalyst prunes the aggregates they do not use.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from flowlens import oracle as O
from flowlens.operators.assemble import assemble_flows, flow_sessions
from flowlens.operators import features as D
from flowlens.operators.features import flow_features
from flowlens.streaming.windows import session_flows
from flowlens.sources import fixtures as fx

HEADER = ["flow_pkt", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

SUBSETS = {
    "flow_volume": (False, ["timestamp", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts",
                            "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s"]),
    "flow_packet_length_stats": (False, ["fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
                                         "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
                                         "pkt_len_max", "pkt_len_min", "pkt_len_mean", "pkt_len_std", "pkt_len_var",
                                         "pkt_size_avg"]),
    "flow_headers_payload": (False, ["fwd_header_len", "bwd_header_len", "fwd_seg_size_min", "fwd_act_data_pkts",
                                     "down_up_ratio"]),
    "flow_iat": (False, ["flow_iat_mean", "flow_iat_max", "flow_iat_min", "flow_iat_std",
                         "fwd_iat_tot", "fwd_iat_max", "fwd_iat_min", "fwd_iat_mean", "fwd_iat_std",
                         "bwd_iat_tot", "bwd_iat_max", "bwd_iat_min", "bwd_iat_mean", "bwd_iat_std"]),
    "flow_flags_windows": (False, ["fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
                                   "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt",
                                   "urg_flag_cnt", "ece_flag_cnt", "init_fwd_win_byts", "init_bwd_win_byts"]),
    "flow_bulk": (False, ["fwd_byts_b_avg", "fwd_pkts_b_avg", "bwd_byts_b_avg", "bwd_pkts_b_avg",
                          "fwd_blk_rate_avg", "bwd_blk_rate_avg"]),
    "flow_active_idle": (False, ["active_max", "active_min", "active_mean", "active_std",
                                 "idle_max", "idle_min", "idle_mean", "idle_std"]),
}


def _sessions(full: bool):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flow_sessions(assemble_flows(fx.packets(spark, sf_dir), long_flow_cut=full))
    return q


def _subset(full: bool, cols: list[str]):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rec = flow_features(assemble_flows(fx.packets(spark, sf_dir), long_flow_cut=full))
        return rec.select(*HEADER, *cols)
    return q


def flow_record_82(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every flow of the packets view as the full 82-field record (R1+R2+R3)."""
    return flow_features(assemble_flows(fx.packets(spark, sf_dir)))


def flow_record_reference_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference session's counting - first packet twice, active/idle 0."""
    return flow_features(assemble_flows(fx.packets(spark, sf_dir), first_packet_weight=2), active_idle="reference")


def flow_record_by_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures kept apart, though each of them numbers its packets from 0."""
    return flow_features(assemble_flows(fx.captures(spark, sf_dir), capture_col="capture"))


# B2: a --fields list; unknown names are ignored and record order is kept
FIELDS = ["flow_duration", "no_such_field", "tot_fwd_pkts", "src_ip", "syn_flag_cnt", "idle_mean"]


def flow_fields_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_features(assemble_flows(fx.packets(spark, sf_dir)), fields=FIELDS)


def _extended(fn):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(assemble_flows(fx.packets(spark, sf_dir), long_flow_cut=False))
    return q


EXTENDED = {
    "flow_response_time": D.flow_response_times,   # D20
    "flow_time_moments": D.flow_time_moments,      # D21
    "flow_length_moments": D.flow_length_moments,  # D22
    "flow_first_sizes": D.flow_first_sizes,        # D23
    "flow_byte_rates": D.flow_byte_rates,          # D24, D25, D28
    "flow_relative_times": D.flow_relative_times,  # D27
}


def session_window_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 batch twin: session_window flows with D1-D4."""
    return session_flows(fx.packets(spark, sf_dir))


def queries() -> dict:
    q = {"flow_sessions_idle": _sessions(False), "flow_sessions_full": _sessions(True)}
    for name, (full, cols) in SUBSETS.items():
        q[name] = _subset(full, cols)
    q["flow_record_82"] = flow_record_82
    q["flow_record_reference_mode"] = flow_record_reference_mode
    q["flow_record_by_capture"] = flow_record_by_capture
    q["flow_fields_projection"] = flow_fields_projection
    for name, fn in EXTENDED.items():
        q[name] = _extended(fn)
    q["session_window_flows"] = session_window_flows
    # flow_key, a hash, has no counterpart in SQL; flow_pkt alone identifies the flows of these packets
    return {name: functools.wraps(fn)(lambda spark, sf_dir, fn=fn: fn(spark, sf_dir).drop("flow_key")) for name, fn in q.items()}


def oracle() -> dict:
    from flowlens.schemas import FLOW_COLUMNS_82
    o = {"flow_sessions_idle": O.sessions_sql(False), "flow_sessions_full": O.sessions_sql(True)}
    for name, (full, cols) in SUBSETS.items():
        o[name] = O.features_sql(HEADER + cols, full)
    o["flow_record_82"] = O.features_sql(["flow_pkt", *FLOW_COLUMNS_82], True)
    o["flow_record_reference_mode"] = O.features_sql(["flow_pkt", *FLOW_COLUMNS_82], True, 2, "reference")
    one = O.features_sql(["flow_pkt", *FLOW_COLUMNS_82], True)
    all_, taps = O.packets_cte(), fx.duckdb_view("captures")
    o["flow_record_by_capture"] = " UNION ALL ".join(
        f"SELECT * FROM ({one.replace(all_, f'packets AS (SELECT * FROM ({taps}) WHERE capture = {tap!r})')}), (SELECT {tap!r} AS capture)" for tap in ("tap0", "tap1", "tap2"))
    o["flow_fields_projection"] = O.features_sql(["flow_pkt"] + [c for c in FLOW_COLUMNS_82 if c in FIELDS], True)
    o.update({"flow_response_time": O.response_time_sql(), "flow_time_moments": O.time_moments_sql(),
              "flow_length_moments": O.length_moments_sql(), "flow_first_sizes": O.first_sizes_sql(),
              "flow_byte_rates": O.byte_rates_sql(), "flow_relative_times": O.relative_times_sql(),
              "session_window_flows": O.session_window_sql()})
    return o
