"""DuckDB oracle SQL for the registered queries.

Each text runs on the driver's pre-registered base views (``events``, ``lineitem``...).
Fixture views are inlined as CTEs from the same SQL texts Spark uses. Formulas mirror
``flowlens.functions.stats`` operation by operation (exact integer moments, then the same
IEEE divisions), so values agree bit for bit rather than within a tolerance.
"""

from __future__ import annotations

from flowlens.sources.fixtures import duckdb_view

KEY = "lo_ip, lo_port, hi_ip, hi_port"
SRC_FIRST = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))"


def mean_sql(n: str, s1: str, scale: bool = False) -> str:
    e = f"CAST({s1} AS DOUBLE) / CAST({n} AS DOUBLE)"
    if scale:
        e = f"{e} / 1000000.0"
    return f"(CASE WHEN {n} > 0 THEN {e} ELSE 0.0 END)"


def var_sql(n: str, s1: str, s2: str) -> str:
    # hugeint -> double casts can round twice; text -> double is correctly rounded
    return (f"(CASE WHEN {n} > 0 THEN CAST(CAST(CAST({n} AS HUGEINT) * CAST({s2} AS HUGEINT) - "
            f"CAST({s1} AS HUGEINT) * CAST({s1} AS HUGEINT) AS VARCHAR) AS DOUBLE) / "
            f"(CAST({n} AS DOUBLE) * CAST({n} AS DOUBLE)) ELSE 0.0 END)")


def std_sql(n: str, s1: str, s2: str, scale: bool = False) -> str:
    e = f"sqrt({var_sql(n, s1, s2)})"
    return f"({e} / 1000000.0)" if scale else e


def div_sql(a: str, b: str, default: str = "0.0") -> str:
    return f"(CASE WHEN {b} IS NOT NULL AND {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {default} END)"


def packets_cte() -> str:
    return f"packets AS ({duckdb_view('packets')})"


def keyed_cte() -> str:
    return f"""k AS (SELECT *,
 CASE WHEN {SRC_FIRST} THEN src_ip ELSE dst_ip END AS lo_ip,
 CASE WHEN {SRC_FIRST} THEN src_port ELSE dst_port END AS lo_port,
 CASE WHEN {SRC_FIRST} THEN dst_ip ELSE src_ip END AS hi_ip,
 CASE WHEN {SRC_FIRST} THEN dst_port ELSE src_port END AS hi_port
 FROM packets WHERE protocol IN (6, 17))"""


def flows_ctes(full: bool, weight: int = 1) -> str:
    """CTEs ending in ``a``: packets with flow_pkt, flow_us, is_fwd (R1, or R1+R2+R3)."""
    head = f"{packets_cte()},\n{keyed_cte()},\n"
    if not full:
        seq = f"""g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {KEY} ORDER BY ts_us, pkt_seq) AS gap0 FROM k),
s AS (SELECT *, sum(CASE WHEN gap0 IS NULL OR gap0 > 240000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY {KEY} ORDER BY ts_us, pkt_seq ROWS UNBOUNDED PRECEDING) AS fseq FROM g),
"""
    else:
        seq = f"""p AS (SELECT *, concat(lo_ip, '|', CAST(lo_port AS VARCHAR), '|', hi_ip, '|', CAST(hi_port AS VARCHAR)) AS kk,
 row_number() OVER (PARTITION BY {KEY} ORDER BY ts_us, pkt_seq) AS rn, contains(tcp_flags, 'F') AS fin FROM k),
w(kk, rn, ts_us, start_us, flow_seq, closed) AS (
 SELECT kk, rn, ts_us, ts_us, 0, false FROM p WHERE rn = 1
 UNION ALL
 SELECT p.kk, p.rn, p.ts_us,
  CASE WHEN w.closed OR p.ts_us - w.ts_us > 240000000 THEN p.ts_us ELSE w.start_us END,
  CASE WHEN w.closed OR p.ts_us - w.ts_us > 240000000 THEN w.flow_seq + 1 ELSE w.flow_seq END,
  CASE WHEN w.closed OR p.ts_us - w.ts_us > 240000000 THEN false
       ELSE p.ts_us - w.start_us > 120000000 OR (p.fin AND p.ts_us - w.start_us >= 90000000) END
 FROM w JOIN p ON p.kk = w.kk AND p.rn = w.rn + 1),
s AS (SELECT p.*, w.flow_seq AS fseq FROM p JOIN w ON p.kk = w.kk AND p.rn = w.rn),
"""
    tail = f"""fl AS (SELECT *, first_value(pkt_seq) OVER wf AS flow_pkt, first_value(ts_us) OVER wf AS flow_us,
 first_value(src_ip) OVER wf AS f_ip, first_value(src_port) OVER wf AS f_port
 FROM s WINDOW wf AS (PARTITION BY {KEY}, fseq ORDER BY ts_us, pkt_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a0 AS (SELECT * EXCLUDE (f_ip, f_port), (src_ip = f_ip AND src_port = f_port) AS is_fwd FROM fl),
a AS (SELECT *, 0 AS rep FROM a0"""
    # first_packet_weight = 2: the first packet of every flow appears twice (Q1)
    tail += " UNION ALL SELECT *, 1 AS rep FROM a0 WHERE pkt_seq = flow_pkt)" if weight == 2 else ")"
    return head + seq + tail


def sessions_sql(full: bool) -> str:
    rec = "RECURSIVE " if full else ""
    return f"""WITH {rec}{flows_ctes(full)}
SELECT max(CASE WHEN pkt_seq = flow_pkt THEN src_ip END) AS src_ip,
 max(CASE WHEN pkt_seq = flow_pkt THEN dst_ip END) AS dst_ip,
 max(CASE WHEN pkt_seq = flow_pkt THEN src_port END) AS src_port,
 max(CASE WHEN pkt_seq = flow_pkt THEN dst_port END) AS dst_port,
 max(CASE WHEN pkt_seq = flow_pkt THEN protocol END) AS protocol,
 min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_pkts
FROM a GROUP BY flow_pkt"""


def _iat(prefix: str, n: str, s1: str, s2: str, mx: str, mn: str, total: bool) -> list[str]:
    ok = f"{n} > 1"
    out = []
    if total:
        out.append(f"CASE WHEN {ok} THEN CAST({s1} AS DOUBLE) / 1000000.0 ELSE 0.0 END AS {prefix}_tot")
    out += [f"CASE WHEN {ok} THEN CAST({mx} AS DOUBLE) / 1000000.0 ELSE 0.0 END AS {prefix}_max",
            f"CASE WHEN {ok} THEN CAST({mn} AS DOUBLE) / 1000000.0 ELSE 0.0 END AS {prefix}_min",
            f"CASE WHEN {ok} THEN {mean_sql(n, s1, True)} ELSE 0.0 END AS {prefix}_mean",
            f"CASE WHEN {ok} THEN {std_sql(n, s1, s2, True)} ELSE 0.0 END AS {prefix}_std"]
    return out


def _moments(x: str, cond: str, nm: str) -> str:
    v = f"CASE WHEN {cond} THEN {x} END" if cond else x
    return (f"count({v}) AS {nm}_n, CAST(coalesce(sum({v}), 0) AS BIGINT) AS {nm}_s1, "
            f"coalesce(sum(CAST({v} AS HUGEINT) * CAST({v} AS HUGEINT)), 0) AS {nm}_s2, "
            f"max({v}) AS {nm}_max, min({v}) AS {nm}_min")


def features_ctes(full: bool, weight: int = 1, active_idle: str = "gaps") -> str:
    """CTEs ending in ``rec``: flow_pkt + the 82 record fields."""
    flags = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "ece": "E"}
    fl = ",\n ".join(f"count(*) FILTER (WHERE contains(tcp_flags, '{c}')) AS {n}_flag_cnt" for n, c in flags.items())
    win = lambda d: (f"coalesce(arg_min(tcp_window, rn) FILTER (WHERE {d} AND protocol = 6 AND tcp_window <> 0), 0)")
    dur = "(CAST(last_us - first_us AS DOUBLE) / 1000000.0)"
    rate = lambda x: f"CASE WHEN last_us <> first_us THEN CAST({x} AS DOUBLE) / {dur} ELSE 0.0 END"
    rec_cols = [
        "flow_pkt", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S') AS timestamp",
        f"{dur} AS flow_duration",
        f"{rate('len_s1')} AS flow_byts_s", f"{rate('n')} AS flow_pkts_s",
        f"{rate('nf')} AS fwd_pkts_s", f"{rate('nb')} AS bwd_pkts_s",
        "nf AS tot_fwd_pkts", "nb AS tot_bwd_pkts", "len_f1 AS totlen_fwd_pkts", "len_b1 AS totlen_bwd_pkts",
        "coalesce(len_fmax, 0) AS fwd_pkt_len_max", "coalesce(len_fmin, 0) AS fwd_pkt_len_min",
        f"{mean_sql('nf', 'len_f1')} AS fwd_pkt_len_mean", f"{std_sql('nf', 'len_f1', 'len_f2')} AS fwd_pkt_len_std",
        "coalesce(len_bmax, 0) AS bwd_pkt_len_max", "coalesce(len_bmin, 0) AS bwd_pkt_len_min",
        f"{mean_sql('nb', 'len_b1')} AS bwd_pkt_len_mean", f"{std_sql('nb', 'len_b1', 'len_b2')} AS bwd_pkt_len_std",
        "len_max AS pkt_len_max", "len_min AS pkt_len_min",
        f"{mean_sql('n', 'len_s1')} AS pkt_len_mean", f"{std_sql('n', 'len_s1', 'len_s2')} AS pkt_len_std",
        f"{var_sql('n', 'len_s1', 'len_s2')} AS pkt_len_var",
        "hdr_f AS fwd_header_len", "hdr_b AS bwd_header_len", "coalesce(hdr_fmin, 0) AS fwd_seg_size_min",
        "act_f AS fwd_act_data_pkts",
        *_iat("flow_iat", "iat_n", "iat_s1", "iat_s2", "iat_max", "iat_min", False),
        *_iat("fwd_iat", "fi_n", "fi_s1", "fi_s2", "fi_max", "fi_min", True),
        *_iat("bwd_iat", "bi_n", "bi_s1", "bi_s2", "bi_max", "bi_min", True),
        "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
        *[f"{n}_flag_cnt" for n in flags],
        f"{div_sql('nb', 'nf')} AS down_up_ratio", f"{mean_sql('n', 'len_s1')} AS pkt_size_avg",
        "init_fwd_win_byts", "init_bwd_win_byts",
        *(_iat("active", "act_n", "act_s1", "act_s2", "act_max", "act_min", False)
          + _iat("idle", "idl_n", "idl_s1", "idl_s2", "idl_max", "idl_min", False)
          if active_idle == "gaps" else
          [f"CAST(0.0 AS DOUBLE) AS {p}_{st}" for p in ("active", "idle") for st in ("max", "min", "mean", "std")]),
        f"{div_sql('fb_bytes', 'fb_cnt')} AS fwd_byts_b_avg", f"{div_sql('fb_pkts', 'fb_cnt')} AS fwd_pkts_b_avg",
        f"{div_sql('bb_bytes', 'bb_cnt')} AS bwd_byts_b_avg", f"{div_sql('bb_pkts', 'bb_cnt')} AS bwd_pkts_b_avg",
        f"{div_sql('fb_bytes', '(CAST(fb_us AS DOUBLE) / 1000000.0)')} AS fwd_blk_rate_avg",
        f"{div_sql('bb_bytes', '(CAST(bb_us AS DOUBLE) / 1000000.0)')} AS bwd_blk_rate_avg",
    ]
    copies = ["fwd_pkt_len_mean AS fwd_seg_size_avg", "bwd_pkt_len_mean AS bwd_seg_size_avg",
              "fwd_urg_flags AS cwr_flag_count", "tot_fwd_pkts AS subflow_fwd_pkts",
              "tot_bwd_pkts AS subflow_bwd_pkts", "totlen_fwd_pkts AS subflow_fwd_byts",
              "totlen_bwd_pkts AS subflow_bwd_byts"]
    return f"""{flows_ctes(full, weight)},
x AS (SELECT *, ts_us - lag(ts_us) OVER wf AS iat, lag(is_fwd) OVER wf AS prev_is_fwd,
 ts_us - lag(ts_us) OVER wd AS dir_iat, row_number() OVER wf AS rn
 FROM a WINDOW wf AS (PARTITION BY flow_pkt ORDER BY ts_us, pkt_seq, rep),
 wd AS (PARTITION BY flow_pkt, is_fwd ORDER BY ts_us, pkt_seq, rep)),
y AS (SELECT *, sum(CASE WHEN iat IS NULL OR iat > 5000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY flow_pkt ORDER BY ts_us, pkt_seq, rep ROWS UNBOUNDED PRECEDING) AS island FROM x),
isl AS (SELECT flow_pkt, island, max(ts_us) - min(ts_us) AS dur,
 max(island) OVER (PARTITION BY flow_pkt) AS last_island FROM y GROUP BY flow_pkt, island),
act AS (SELECT flow_pkt, {_moments('dur', 'island < last_island AND dur > 0', 'act')} FROM isl GROUP BY flow_pkt),
pay AS (SELECT flow_pkt, ts_us, pkt_seq, is_fwd, payload_len,
 lag(ts_us) OVER wp AS pts, lag(is_fwd) OVER wp AS pfwd
 FROM a WHERE payload_len > 0 AND rep = 0 WINDOW wp AS (PARTITION BY flow_pkt ORDER BY ts_us, pkt_seq)),
pay2 AS (SELECT *, sum(CASE WHEN pts IS NULL OR pfwd <> is_fwd OR ts_us - pts > 1000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY flow_pkt ORDER BY ts_us, pkt_seq ROWS UNBOUNDED PRECEDING) AS run FROM pay),
runs AS (SELECT flow_pkt, run, bool_and(is_fwd) AS is_fwd, count(*) AS c, sum(payload_len) AS b,
 max(ts_us) - min(ts_us) AS d FROM pay2 GROUP BY flow_pkt, run HAVING count(*) >= 4),
blk AS (SELECT flow_pkt,
 count(*) FILTER (WHERE is_fwd) AS fb_cnt, CAST(coalesce(sum(c) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fb_pkts,
 CAST(coalesce(sum(b) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fb_bytes, CAST(coalesce(sum(d) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fb_us,
 count(*) FILTER (WHERE NOT is_fwd) AS bb_cnt, CAST(coalesce(sum(c) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bb_pkts,
 CAST(coalesce(sum(b) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bb_bytes, CAST(coalesce(sum(d) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bb_us
 FROM runs GROUP BY flow_pkt),
m AS (SELECT flow_pkt,
 max(CASE WHEN pkt_seq = flow_pkt THEN src_ip END) AS src_ip, max(CASE WHEN pkt_seq = flow_pkt THEN dst_ip END) AS dst_ip,
 max(CASE WHEN pkt_seq = flow_pkt THEN src_port END) AS src_port, max(CASE WHEN pkt_seq = flow_pkt THEN dst_port END) AS dst_port,
 max(CASE WHEN pkt_seq = flow_pkt THEN protocol END) AS protocol,
 min(ts_us) AS first_us, max(ts_us) AS last_us,
 count(*) AS n, count(*) FILTER (WHERE is_fwd) AS nf, count(*) FILTER (WHERE NOT is_fwd) AS nb,
 CAST(sum(frame_len) AS BIGINT) AS len_s1,
 CAST(coalesce(sum(frame_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS len_f1,
 CAST(coalesce(sum(frame_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS len_b1,
 sum(CAST(frame_len AS HUGEINT) * frame_len) AS len_s2,
 coalesce(sum(CAST(frame_len AS HUGEINT) * frame_len) FILTER (WHERE is_fwd), 0) AS len_f2,
 coalesce(sum(CAST(frame_len AS HUGEINT) * frame_len) FILTER (WHERE NOT is_fwd), 0) AS len_b2,
 max(frame_len) AS len_max, min(frame_len) AS len_min,
 max(frame_len) FILTER (WHERE is_fwd) AS len_fmax, min(frame_len) FILTER (WHERE is_fwd) AS len_fmin,
 max(frame_len) FILTER (WHERE NOT is_fwd) AS len_bmax, min(frame_len) FILTER (WHERE NOT is_fwd) AS len_bmin,
 CAST(coalesce(sum(ip_hdr_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS hdr_f,
 CAST(coalesce(sum(ip_hdr_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS hdr_b,
 CAST(min(ip_hdr_len) FILTER (WHERE is_fwd) AS BIGINT) AS hdr_fmin,
 count(*) FILTER (WHERE is_fwd AND payload_len > 0) AS act_f,
 {_moments('iat', '', 'iat')},
 {_moments('dir_iat', 'is_fwd', 'fi')},
 {_moments('dir_iat', 'NOT is_fwd', 'bi')},
 {_moments('iat', 'iat > 5000000', 'idl')},
 count(*) FILTER (WHERE is_fwd AND contains(tcp_flags, 'P')) AS fwd_psh_flags,
 count(*) FILTER (WHERE NOT is_fwd AND contains(tcp_flags, 'P')) AS bwd_psh_flags,
 count(*) FILTER (WHERE is_fwd AND contains(tcp_flags, 'U')) AS fwd_urg_flags,
 count(*) FILTER (WHERE NOT is_fwd AND contains(tcp_flags, 'U')) AS bwd_urg_flags,
 {fl},
 {win('is_fwd')} AS init_fwd_win_byts, {win('NOT is_fwd')} AS init_bwd_win_byts
 FROM x GROUP BY flow_pkt),
j AS (SELECT m.*, coalesce(act.act_n, 0) AS act_n, coalesce(act.act_s1, 0) AS act_s1, coalesce(act.act_s2, 0) AS act_s2,
 act.act_max, act.act_min,
 coalesce(fb_cnt, 0) AS fb_cnt, coalesce(fb_pkts, 0) AS fb_pkts, coalesce(fb_bytes, 0) AS fb_bytes, coalesce(fb_us, 0) AS fb_us,
 coalesce(bb_cnt, 0) AS bb_cnt, coalesce(bb_pkts, 0) AS bb_pkts, coalesce(bb_bytes, 0) AS bb_bytes, coalesce(bb_us, 0) AS bb_us
 FROM m LEFT JOIN act USING (flow_pkt) LEFT JOIN blk USING (flow_pkt)),
r0 AS (SELECT {", ".join(rec_cols)} FROM j),
rec AS (SELECT *, {", ".join(copies)} FROM r0)"""


def features_sql(columns: list[str], full: bool, weight: int = 1, active_idle: str = "gaps") -> str:
    rec = "RECURSIVE " if full else ""
    return f"WITH {rec}{features_ctes(full, weight, active_idle)}\nSELECT {', '.join(columns)} FROM rec"


# ---------------------------------------------------------------------------
# Extended statistics (D20-D28) and session windows (H2), on idle-split flows.
# ---------------------------------------------------------------------------

def _median_mode_ctes(src: str, val: str, name: str) -> str:
    """Exact median (mean of the two middle values) and lowest most frequent value per flow."""
    return f"""{name}_vc AS (SELECT flow_pkt, {val} AS v, count(*) AS c FROM {src} GROUP BY ALL),
{name}_cum AS (SELECT *, sum(c) OVER (PARTITION BY flow_pkt ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
 sum(c) OVER (PARTITION BY flow_pkt) AS tot FROM {name}_vc),
{name}_mm AS (SELECT flow_pkt,
 CAST(min(v) FILTER (WHERE cum > floor((tot - 1) / 2)) + min(v) FILTER (WHERE cum > floor(tot / 2)) AS DOUBLE) / 2.0 AS med,
 first(v ORDER BY c DESC, v ASC) AS mode FROM {name}_cum GROUP BY flow_pkt)"""


def _ctx_ctes() -> str:
    return f"""WITH {flows_ctes(False)},
x AS (SELECT *, ts_us - lag(ts_us) OVER wf AS iat, lag(is_fwd) OVER wf AS prev_is_fwd,
 row_number() OVER wf AS rn FROM a WINDOW wf AS (PARTITION BY flow_pkt ORDER BY ts_us, pkt_seq))"""


def response_time_sql() -> str:
    return f"""{_ctx_ctes()},
rt AS (SELECT flow_pkt, iat AS resp FROM x WHERE prev_is_fwd AND NOT is_fwd),
base AS (SELECT DISTINCT flow_pkt FROM a),
m AS (SELECT flow_pkt, count(*) AS n, CAST(sum(resp) AS BIGINT) AS s1, sum(CAST(resp AS HUGEINT) * resp) AS s2 FROM rt GROUP BY flow_pkt),
{_median_mode_ctes('rt', 'resp', 'r')},
j AS (SELECT base.flow_pkt, coalesce(m.n, 0) AS n, m.s1, m.s2, r_mm.med, r_mm.mode FROM base
 LEFT JOIN m USING (flow_pkt) LEFT JOIN r_mm USING (flow_pkt)),
st AS (SELECT flow_pkt,
 CASE WHEN n > 0 THEN {var_sql('n', 's1', 's2')} / 1000000000000.0 ELSE -1.0 END AS resp_var,
 CASE WHEN n > 0 THEN {mean_sql('n', 's1', True)} ELSE -1.0 END AS resp_mean,
 med / 1000000.0 AS resp_median,
 CASE WHEN n > 0 THEN CAST(mode AS DOUBLE) / 1000000.0 ELSE -1.0 END AS resp_mode,
 CASE WHEN n > 0 THEN {std_sql('n', 's1', 's2', True)} ELSE -1.0 END AS resp_std FROM j)
SELECT *, CASE WHEN resp_std <> 0 THEN 3.0 * (resp_mean - resp_median) / resp_std ELSE -10.0 END AS resp_skew,
 CASE WHEN resp_std <> 0 THEN (resp_mean - resp_mode) / resp_std ELSE -10.0 END AS resp_skew2,
 CASE WHEN resp_mean <> 0 THEN resp_std / resp_mean ELSE -1.0 END AS resp_cov FROM st"""


def time_moments_sql() -> str:
    return f"""{_ctx_ctes()},
rel AS (SELECT flow_pkt, ts_us - flow_us AS rel_us FROM a),
m AS (SELECT flow_pkt, count(*) AS n, CAST(sum(rel_us) AS BIGINT) AS s1, sum(CAST(rel_us AS HUGEINT) * rel_us) AS s2 FROM rel GROUP BY flow_pkt),
{_median_mode_ctes('rel', 'rel_us', 't')},
st AS (SELECT flow_pkt, {var_sql('n', 's1', 's2')} / 1000000000000.0 AS time_var, {std_sql('n', 's1', 's2', True)} AS time_std,
 {mean_sql('n', 's1', True)} AS time_mean, med / 1000000.0 AS time_median, CAST(mode AS DOUBLE) / 1000000.0 AS time_mode
 FROM m JOIN t_mm USING (flow_pkt))
SELECT *, CASE WHEN time_std <> 0 THEN 3.0 * (time_mean - time_median) / time_std ELSE -10.0 END AS time_skew,
 CASE WHEN time_std <> 0 THEN (time_mean - time_mode) / time_std ELSE -10.0 END AS time_skew2,
 CASE WHEN time_mean <> 0 THEN time_std / time_mean ELSE -1.0 END AS time_cov FROM st"""


def length_moments_sql() -> str:
    return f"""{_ctx_ctes()},
m AS (SELECT flow_pkt, count(*) AS n, CAST(sum(frame_len) AS BIGINT) AS s1, sum(CAST(frame_len AS HUGEINT) * frame_len) AS s2 FROM a GROUP BY flow_pkt),
{_median_mode_ctes('a', 'frame_len', 'l')},
st AS (SELECT flow_pkt, {mean_sql('n', 's1')} AS mean, {std_sql('n', 's1', 's2')} AS std, med AS len_median, mode AS len_mode
 FROM m JOIN l_mm USING (flow_pkt))
SELECT flow_pkt, len_median, len_mode,
 CASE WHEN std <> 0 THEN 3.0 * (mean - len_median) / std ELSE -10.0 END AS len_skew,
 CASE WHEN std <> 0 THEN (mean - CAST(len_mode AS DOUBLE)) / std ELSE -10.0 END AS len_skew2,
 CASE WHEN mean <> 0 THEN std / mean ELSE -1.0 END AS len_cov FROM st"""


def first_sizes_sql() -> str:
    return f"""{_ctx_ctes()}
SELECT flow_pkt, list(frame_len ORDER BY rn) FILTER (WHERE rn <= 50) AS first_sizes FROM x GROUP BY flow_pkt"""


def byte_rates_sql() -> str:
    dur = "(CAST(last_us - first_us AS DOUBLE) / 1000000.0)"
    rate = lambda x: f"CASE WHEN last_us <> first_us THEN CAST({x} AS DOUBLE) / {dur} ELSE -1.0 END"
    return f"""{_ctx_ctes()},
gg AS (SELECT flow_pkt, CAST(coalesce(sum(frame_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS bytes_sent,
 CAST(coalesce(sum(frame_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bytes_received,
 CAST(coalesce(sum(ip_hdr_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fwd_hdr,
 CAST(coalesce(sum(ip_hdr_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bwd_hdr,
 CAST(min(ip_hdr_len) FILTER (WHERE is_fwd) AS BIGINT) AS fwd_hdr_min, CAST(min(ip_hdr_len) FILTER (WHERE NOT is_fwd) AS BIGINT) AS bwd_hdr_min,
 min(ts_us) AS first_us, max(ts_us) AS last_us FROM a GROUP BY flow_pkt)
SELECT flow_pkt, bytes_sent, bytes_received, {rate('bytes_sent')} AS sent_rate, {rate('bytes_received')} AS received_rate,
 {rate('fwd_hdr')} AS fwd_header_rate, {rate('bwd_hdr')} AS bwd_header_rate,
 {div_sql('fwd_hdr', 'bwd_hdr', '-1.0')} AS header_in_out_ratio, fwd_hdr, bwd_hdr, fwd_hdr_min, bwd_hdr_min FROM gg"""


def relative_times_sql() -> str:
    return f"""{_ctx_ctes()}
SELECT flow_pkt, rn - 1 AS idx, coalesce(CAST(iat AS DOUBLE) / 1000000.0, 0.0) AS rel_time FROM x"""


def session_window_sql() -> str:
    return f"""WITH {flows_ctes(False)}
SELECT lo_ip, lo_port, hi_ip, hi_port, min(ts_us) AS start_us, max(ts_us) + 240000000 AS end_us,
 count(*) FILTER (WHERE is_fwd) AS tot_fwd_pkts, count(*) FILTER (WHERE NOT is_fwd) AS tot_bwd_pkts,
 CAST(coalesce(sum(frame_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS totlen_fwd_pkts,
 CAST(coalesce(sum(frame_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS totlen_bwd_pkts,
 CAST(max(ts_us) - min(ts_us) AS DOUBLE) / 1000000.0 AS flow_duration
FROM a GROUP BY lo_ip, lo_port, hi_ip, hi_port, flow_pkt"""
