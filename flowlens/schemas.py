"""Declared schemas, column orders and name maps.

The reference keeps no declared schema (ordered dicts, positional CSV, inferred frames);
every table here has one.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Packets table (one row per captured IP packet, headers only). Order is (ts_us, pkt_seq).
PACKETS = T.StructType([
    T.StructField("pkt_seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("ip_hdr_len", T.IntegerType()),
    T.StructField("payload_len", T.LongType()),
    T.StructField("frame_len", T.LongType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("tcp_window", T.LongType()),
])
PACKET_OPTIONAL = {"ttl": T.IntegerType(), "capture": T.StringType()}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: flow timing constants (seconds).
# EXPIRED_UPDATE 240, CLUMP_TIMEOUT 1, ACTIVE_TIMEOUT 5, BULK_BOUND 4,
# long-flow cut 120 s, FIN close at duration >= 90 s.
# ---------------------------------------------------------------------------
IDLE_TIMEOUT_US = 240_000_000
CLUMP_TIMEOUT_US = 1_000_000
ACTIVE_TIMEOUT_US = 5_000_000
BULK_BOUND = 4
LONG_FLOW_US = 120_000_000
FIN_CLOSE_US = 90_000_000

# ---------------------------------------------------------------------------
# The 82-field flow record, in the reference's output order.
# ---------------------------------------------------------------------------
FLOW_COLUMNS_82 = [
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp",
    "flow_duration", "flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s",
    "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
    "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
    "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
    "pkt_len_max", "pkt_len_min", "pkt_len_mean", "pkt_len_std", "pkt_len_var",
    "fwd_header_len", "bwd_header_len", "fwd_seg_size_min", "fwd_act_data_pkts",
    "flow_iat_mean", "flow_iat_max", "flow_iat_min", "flow_iat_std",
    "fwd_iat_tot", "fwd_iat_max", "fwd_iat_min", "fwd_iat_mean", "fwd_iat_std",
    "bwd_iat_tot", "bwd_iat_max", "bwd_iat_min", "bwd_iat_mean", "bwd_iat_std",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
    "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt",
    "ack_flag_cnt", "urg_flag_cnt", "ece_flag_cnt", "down_up_ratio",
    "pkt_size_avg", "init_fwd_win_byts", "init_bwd_win_byts",
    "active_max", "active_min", "active_mean", "active_std",
    "idle_max", "idle_min", "idle_mean", "idle_std",
    "fwd_byts_b_avg", "fwd_pkts_b_avg", "bwd_byts_b_avg", "bwd_pkts_b_avg",
    "fwd_blk_rate_avg", "bwd_blk_rate_avg", "fwd_seg_size_avg", "bwd_seg_size_avg",
    "cwr_flag_count", "subflow_fwd_pkts", "subflow_bwd_pkts",
    "subflow_fwd_byts", "subflow_bwd_byts",
]
# The 80-field variant has no src_ip / dst_ip.
FLOW_COLUMNS_80 = FLOW_COLUMNS_82[2:]

# Record fields that are integers; all other numeric fields are doubles.
FLOW_LONG_FIELDS = {
    "src_port", "dst_port", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
    "fwd_pkt_len_max", "fwd_pkt_len_min", "bwd_pkt_len_max", "bwd_pkt_len_min",
    "pkt_len_max", "pkt_len_min", "fwd_header_len", "bwd_header_len", "fwd_seg_size_min",
    "fwd_act_data_pkts", "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
    "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt",
    "urg_flag_cnt", "ece_flag_cnt", "init_fwd_win_byts", "init_bwd_win_byts",
    "cwr_flag_count", "subflow_fwd_pkts", "subflow_bwd_pkts", "subflow_fwd_byts", "subflow_bwd_byts",
}

# ---------------------------------------------------------------------------
# Short record names -> dataset (model) feature names, 77 entries,
# in the reference's order. src_ip, dst_ip, src_port, protocol, timestamp are unmapped.
# ---------------------------------------------------------------------------
FEATURE_NAME_MAP = {
    "dst_port": "Destination Port",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Total Fwd Packets",
    "tot_bwd_pkts": "Total Backward Packets",
    "totlen_fwd_pkts": "Total Length of Fwd Packets",
    "totlen_bwd_pkts": "Total Length of Bwd Packets",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_tot": "Fwd IAT Total",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "bwd_iat_tot": "Bwd IAT Total",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fwd_header_len": "Fwd Header Length",
    "bwd_header_len": "Bwd Header Length",
    "fwd_pkts_s": "Fwd Packets/s",
    "bwd_pkts_s": "Bwd Packets/s",
    "pkt_len_min": "Min Packet Length",
    "pkt_len_max": "Max Packet Length",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_var": "Packet Length Variance",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "cwr_flag_count": "CWE Flag Count",
    "ece_flag_cnt": "ECE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Average Packet Size",
    "fwd_seg_size_avg": "Avg Fwd Segment Size",
    "bwd_seg_size_avg": "Avg Bwd Segment Size",
    "fwd_byts_b_avg": "Fwd Avg Bytes/Bulk",
    "fwd_pkts_b_avg": "Fwd Avg Packets/Bulk",
    "fwd_blk_rate_avg": "Fwd Avg Bulk Rate",
    "bwd_byts_b_avg": "Bwd Avg Bytes/Bulk",
    "bwd_pkts_b_avg": "Bwd Avg Packets/Bulk",
    "bwd_blk_rate_avg": "Bwd Avg Bulk Rate",
    "subflow_fwd_pkts": "Subflow Fwd Packets",
    "subflow_fwd_byts": "Subflow Fwd Bytes",
    "subflow_bwd_pkts": "Subflow Bwd Packets",
    "subflow_bwd_byts": "Subflow Bwd Bytes",
    "init_fwd_win_byts": "Init_Win_bytes_forward",
    "init_bwd_win_byts": "Init_Win_bytes_backward",
    "fwd_act_data_pkts": "act_data_pkt_fwd",
    "fwd_seg_size_min": "min_seg_size_forward",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}
MODEL_FEATURES_DEFAULT = list(FEATURE_NAME_MAP.values())

# Identifier columns dropped before training (default profile and the
# serving preprocessor; the paper profile keeps the duplicate header column unless equal).
ID_COLUMNS_DEFAULT = ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Fwd Header Length.1"]
ID_COLUMNS_PAPER = ["Flow ID", "Source IP", "Destination IP", "Timestamp"]

# Labels treated as "unknown" attacks by the paper split (case-insensitive):
# contains "slowloris", contains "slowhttptest", or equals "bot".
UNKNOWN_LABEL_SUBSTRINGS = ["slowloris", "slowhttptest"]
UNKNOWN_LABEL_EXACT = ["bot"]
BENIGN_LABEL = "BENIGN"
