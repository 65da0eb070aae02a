"""Flow features: assembled packets -> one record per flow (operators D1-D28).

Plan shape: one exchange on the flow's identity, two window passes with one spec over one sort
(or, opt-in for hot flows, windows per (flow, time bucket) with carries from a small
per-bucket summary, see ``packet_context``); then one ``groupBy`` on it whose aggregates are all algebraic (counts, sums,
exact sums of squares, min, max), so partial aggregation applies before its exchange.
Per-direction lags use ``last(..., ignorenulls)`` over ``UNBOUNDED PRECEDING .. 1 PRECEDING``
instead of a second partitioning, and the bulk state machine (D17) is re-expressed as
running windows: the contribution of a payload packet depends only on its position in the
current run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.stats import (dsum, epoch_us_to_string, fcount, mean_of, safe_div, std_of,
                                      sumsq, var_of)
from flowlens.operators.assemble import FLOW_ID, ORDER, is_first
from flowlens.schemas import ACTIVE_TIMEOUT_US, BULK_BOUND, CLUMP_TIMEOUT_US, FLOW_COLUMNS_82

US = 1_000_000.0


BUCKET_US = 1_000_000  # time bucket inside a flow for the skew-spread scan (opt-in)


def _w():
    return Window.partitionBy(*FLOW_ID).orderBy(*ORDER)


def packet_context(assembled: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """Per-packet lag and running columns used by the flow aggregates.

    Default (``bucket_us=None``): one window spec per flow, two passes over one sort - a
    linear plan with a single exchange. With ``bucket_us`` the scan is split by time (below);
    that plan branches into per-bucket summaries, so give it a materialised input (e.g. the
    tagged packets written to the shared checkpoint directory) to avoid recomputing the
    assembly per branch.
    """
    if bucket_us is None:
        return _packet_context_linear(assembled)
    return _packet_context_bucketed(assembled, bucket_us)


def _packet_context_bucketed(assembled: DataFrame, bucket_us: int) -> DataFrame:
    """A scan over a flow's packets is split into time buckets so one hot flow is not one
    window task: windows run per (flow, bucket), and what a row needs from earlier buckets
    (previous packet, last forward / backward time, last payload packet, running payload
    count and sum, last idle-island start, last bulk-run break) comes from a per-bucket
    summary with a window over buckets (one row per active bucket), joined back on
    (flow, bucket). Two such rounds: the second needs the gaps of the first."""
    c = F.col
    fwd = c("is_fwd")
    a = assembled.withColumns({
        "fb": F.floor(c("ts_us") / F.lit(bucket_us)).cast("long"),
        "is_payload": (c("payload_len") > 0) & (c("rep") == 0),
    })
    wl = Window.partitionBy(*FLOW_ID, "fb").orderBy(*ORDER)
    before = wl.rowsBetween(Window.unboundedPreceding, -1)
    upto = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ws = Window.partitionBy(*FLOW_ID).orderBy("fb")
    ws_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(*ORDER)
    pay_struct = F.struct(c("ts_us").alias("t"), fwd.alias("f"))

    # round 1: local lags and running sums, and their carries from earlier buckets
    a = a.withColumns({
        "l_prev_ts": F.lag("ts_us").over(wl),
        "l_prev_is_fwd": F.lag("is_fwd").over(wl),
        "l_prev_fwd_ts": F.last(F.when(fwd, c("ts_us")), ignorenulls=True).over(before),
        "l_prev_bwd_ts": F.last(F.when(~fwd, c("ts_us")), ignorenulls=True).over(before),
        "l_prev_pay": F.last(F.when(c("is_payload"), pay_struct), ignorenulls=True).over(before),
        "l_pay_n": F.sum(F.when(c("is_payload"), 1).otherwise(0)).over(upto),
        "l_pay_sum": F.sum(F.when(c("is_payload"), c("payload_len")).otherwise(0)).over(upto),
    })
    s1 = a.groupBy(*FLOW_ID, "fb").agg(
        F.max_by(pay_struct, order).alias("last_row"),
        F.max(F.when(fwd, c("ts_us"))).alias("last_fwd"), F.max(F.when(~fwd, c("ts_us"))).alias("last_bwd"),
        F.max_by(F.when(c("is_payload"), pay_struct), F.when(c("is_payload"), order)).alias("last_pay"),
        F.sum(F.when(c("is_payload"), 1).otherwise(0)).alias("b_pay_n"),
        F.sum(F.when(c("is_payload"), c("payload_len")).otherwise(0)).alias("b_pay_sum"))
    c1 = s1.select(*FLOW_ID, "fb",
                   F.lag("last_row").over(ws).alias("c_last_row"),
                   F.max("last_fwd").over(ws_before).alias("c_fwd_ts"),
                   F.max("last_bwd").over(ws_before).alias("c_bwd_ts"),
                   F.last("last_pay", ignorenulls=True).over(ws_before).alias("c_pay"),
                   F.coalesce(F.sum("b_pay_n").over(ws_before), F.lit(0)).alias("c_pay_n"),
                   F.coalesce(F.sum("b_pay_sum").over(ws_before), F.lit(0)).cast("long").alias("c_pay_sum"))
    a = a.join(c1, on=[*FLOW_ID, "fb"], how="left")
    first_in_bucket = c("l_prev_ts").isNull()
    a = a.withColumns({
        "prev_ts": F.coalesce(c("l_prev_ts"), c("c_last_row.t")),
        "prev_is_fwd": F.when(first_in_bucket, c("c_last_row.f")).otherwise(c("l_prev_is_fwd")),
        "prev_fwd_ts": F.coalesce(c("l_prev_fwd_ts"), c("c_fwd_ts")),
        "prev_bwd_ts": F.coalesce(c("l_prev_bwd_ts"), c("c_bwd_ts")),
        "prev_pay": F.coalesce(c("l_prev_pay"), c("c_pay")),
        "pay_n": c("l_pay_n") + c("c_pay_n"),
        "pay_sum": c("l_pay_sum") + c("c_pay_sum"),
    })
    gap = c("ts_us") - c("prev_ts")
    a = a.withColumns({
        "iat": gap,
        "dir_iat": c("ts_us") - F.when(fwd, c("prev_fwd_ts")).otherwise(c("prev_bwd_ts")),
        "resp": F.when(c("prev_is_fwd") & ~fwd, gap),
        "island_start": c("prev_ts").isNull() | (gap > ACTIVE_TIMEOUT_US),
        "brk": c("is_payload") & (c("prev_pay").isNull() | (c("prev_pay.f") != fwd)
                                  | ((c("ts_us") - c("prev_pay.t")) > CLUMP_TIMEOUT_US)),
    })
    # round 2: last island start and last run break, locally and carried
    brk_struct = F.struct(c("pay_n").alias("n"), c("ts_us").alias("t"), (c("pay_sum") - c("payload_len")).alias("base"))
    a = a.withColumns({
        "l_island": F.last(F.when(c("island_start"), c("ts_us")), ignorenulls=True).over(before),
        "l_run": F.last(F.when(c("brk"), brk_struct), ignorenulls=True).over(upto),
    })
    s2 = a.groupBy(*FLOW_ID, "fb").agg(
        F.max(F.when(c("island_start"), c("ts_us"))).alias("b_island"),
        F.max_by(F.when(c("brk"), brk_struct), F.when(c("brk"), order)).alias("b_run"))
    c2 = s2.select(*FLOW_ID, "fb", F.max("b_island").over(ws_before).alias("c_island"),
                   F.last("b_run", ignorenulls=True).over(ws_before).alias("c_run"))
    a = a.join(c2, on=[*FLOW_ID, "fb"], how="left")
    run = F.coalesce(c("l_run"), c("c_run"))
    a = a.withColumns({
        "prev_island_us": F.coalesce(c("l_island"), c("c_island")),
        "run_first_n": run["n"], "run_first_us": run["t"], "run_base_sum": run["base"],
    })
    k = c("pay_n") - c("run_first_n") + 1
    at_bound = c("is_payload") & (k == BULK_BOUND)
    past_bound = c("is_payload") & (k > BULK_BOUND)
    return a.withColumns({
        "blk_start": at_bound,
        "blk_pkts": F.when(at_bound, F.lit(BULK_BOUND)).when(past_bound, 1).otherwise(0).cast("long"),
        "blk_bytes": F.when(at_bound, c("pay_sum") - c("run_base_sum"))
        .when(past_bound, c("payload_len")).otherwise(0).cast("long"),
        "blk_us": F.when(at_bound, c("ts_us") - c("run_first_us"))
        .when(past_bound, c("ts_us") - c("prev_pay.t")).otherwise(0).cast("long"),
        "idle_us": F.when(c("iat") > ACTIVE_TIMEOUT_US, c("iat")),
        "active_us": F.when((c("iat") > ACTIVE_TIMEOUT_US) & ((c("prev_ts") - c("prev_island_us")) > 0),
                            c("prev_ts") - c("prev_island_us")),
    })


def _packet_context_linear(assembled: DataFrame) -> DataFrame:
    """Per-packet lag columns used by the flow aggregates (two passes, one sort)."""
    w = _w()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_payload = (F.col("payload_len") > 0) & (F.col("rep") == 0)
    c = assembled.withColumns({
        "prev_ts": F.lag("ts_us").over(w),
        "prev_is_fwd": F.lag("is_fwd").over(w),
        "prev_fwd_ts": F.last(F.when(F.col("is_fwd"), F.col("ts_us")), ignorenulls=True).over(before),
        "prev_bwd_ts": F.last(F.when(~F.col("is_fwd"), F.col("ts_us")), ignorenulls=True).over(before),
        "prev_pay": F.last(F.when(is_payload, F.struct(F.col("ts_us").alias("t"), F.col("is_fwd").alias("f"))),
                           ignorenulls=True).over(before),
        "is_payload": is_payload,
    })
    gap = F.col("ts_us") - F.col("prev_ts")
    c = c.withColumns({
        "iat": gap,
        "dir_iat": F.col("ts_us") - F.when(F.col("is_fwd"), F.col("prev_fwd_ts")).otherwise(F.col("prev_bwd_ts")),
        "resp": F.when(F.col("prev_is_fwd") & ~F.col("is_fwd"), gap),
        "island_start": F.col("prev_ts").isNull() | (gap > ACTIVE_TIMEOUT_US),
        "brk": is_payload & (F.col("prev_pay").isNull() | (F.col("prev_pay.f") != F.col("is_fwd"))
                             | ((F.col("ts_us") - F.col("prev_pay.t")) > CLUMP_TIMEOUT_US)),
    })
    # second pass, same window spec: run positions and island starts
    c = c.withColumns({
        "pay_n": F.sum(F.when(F.col("is_payload"), 1).otherwise(0)).over(upto),
        "pay_sum": F.sum(F.when(F.col("is_payload"), F.col("payload_len")).otherwise(0)).over(upto),
        "prev_island_us": F.last(F.when(F.col("island_start"), F.col("ts_us")), ignorenulls=True).over(before),
    })
    c = c.withColumns({
        "run_first_n": F.last(F.when(F.col("brk"), F.col("pay_n")), ignorenulls=True).over(upto),
        "run_first_us": F.last(F.when(F.col("brk"), F.col("ts_us")), ignorenulls=True).over(upto),
        "run_base_sum": F.last(F.when(F.col("brk"), F.col("pay_sum") - F.col("payload_len")),
                               ignorenulls=True).over(upto),
    })
    k = F.col("pay_n") - F.col("run_first_n") + 1
    at_bound = F.col("is_payload") & (k == BULK_BOUND)
    past_bound = F.col("is_payload") & (k > BULK_BOUND)
    c = c.withColumns({
        "blk_start": at_bound,
        "blk_pkts": F.when(at_bound, F.lit(BULK_BOUND)).when(past_bound, 1).otherwise(0).cast("long"),
        "blk_bytes": F.when(at_bound, F.col("pay_sum") - F.col("run_base_sum"))
        .when(past_bound, F.col("payload_len")).otherwise(0).cast("long"),
        "blk_us": F.when(at_bound, F.col("ts_us") - F.col("run_first_us"))
        .when(past_bound, F.col("ts_us") - F.col("prev_pay.t")).otherwise(0).cast("long"),
        "idle_us": F.when(F.col("iat") > ACTIVE_TIMEOUT_US, F.col("iat")),
        "active_us": F.when((F.col("iat") > ACTIVE_TIMEOUT_US)
                            & ((F.col("prev_ts") - F.col("prev_island_us")) > 0),
                            F.col("prev_ts") - F.col("prev_island_us")),
    })
    return c


def _flag(letter: str) -> Column:
    return F.coalesce(F.col("tcp_flags"), F.lit("")).contains(letter)


def _iat_stats(prefix: str, n: Column, s1: Column, s2: Column, mx: Column, mn: Column,
               with_total: bool) -> dict[str, Column]:
    """get_statistics(): all 0 unless the list has more than one value (Q3)."""
    ok = n > 1
    out = {}
    if with_total:
        out[f"{prefix}_tot"] = F.when(ok, s1.cast("double") / US).otherwise(0.0)
    out[f"{prefix}_max"] = F.when(ok, mx.cast("double") / US).otherwise(0.0)
    out[f"{prefix}_min"] = F.when(ok, mn.cast("double") / US).otherwise(0.0)
    out[f"{prefix}_mean"] = F.when(ok, mean_of(n, s1, US)).otherwise(0.0)
    out[f"{prefix}_std"] = F.when(ok, std_of(n, s1, s2, US)).otherwise(0.0)
    return out


def flow_aggregates(ctx: DataFrame) -> DataFrame:
    """One groupBy over the packet context: raw moments for every 82-record field."""
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")
    L, H = F.col("frame_len"), F.col("ip_hdr_len").cast("long")
    first = is_first()
    tcp_win = lambda d: F.coalesce(F.min_by(
        F.col("tcp_window"),
        F.when(d & (F.col("protocol") == 6) & (F.col("tcp_window") != 0), F.struct(*ORDER))), F.lit(0).cast("long"))
    aggs = [
        F.max(F.when(first, F.col("src_ip"))).alias("src_ip"),
        F.max(F.when(first, F.col("dst_ip"))).alias("dst_ip"),
        F.max(F.when(first, F.col("src_port"))).alias("src_port"),
        F.max(F.when(first, F.col("dst_port"))).alias("dst_port"),
        F.max(F.when(first, F.col("protocol"))).alias("protocol"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("n"), fcount(fwd).alias("nf"), fcount(bwd).alias("nb"),
        dsum(L).alias("len_s1"), dsum(L, fwd).alias("len_f1"), dsum(L, bwd).alias("len_b1"),
        sumsq(L).alias("len_s2"), sumsq(L, fwd).alias("len_f2"), sumsq(L, bwd).alias("len_b2"),
        F.max(L).alias("len_max"), F.min(L).alias("len_min"),
        F.max(F.when(fwd, L)).alias("len_fmax"), F.min(F.when(fwd, L)).alias("len_fmin"),
        F.max(F.when(bwd, L)).alias("len_bmax"), F.min(F.when(bwd, L)).alias("len_bmin"),
        dsum(H, fwd).alias("hdr_f"), dsum(H, bwd).alias("hdr_b"), F.min(F.when(fwd, H)).alias("hdr_fmin"),
        fcount(fwd & (F.col("payload_len") > 0)).alias("act_f"),
        F.count("iat").alias("iat_n"), dsum(F.col("iat")).alias("iat_s1"),
        sumsq(F.col("iat"), wide=True).alias("iat_s2"), F.max("iat").alias("iat_max"), F.min("iat").alias("iat_min"),
    ]
    for d, nm in ((fwd, "fi"), (bwd, "bi")):
        x = F.when(d, F.col("dir_iat"))
        aggs += [F.count(x).alias(f"{nm}_n"), dsum(x).alias(f"{nm}_s1"), sumsq(x, wide=True).alias(f"{nm}_s2"),
                 F.max(x).alias(f"{nm}_max"), F.min(x).alias(f"{nm}_min")]
    for nm in ("idle_us", "active_us"):
        x = F.col(nm)
        aggs += [F.count(x).alias(f"{nm}_n"), dsum(x).alias(f"{nm}_s1"), sumsq(x, wide=True).alias(f"{nm}_s2"),
                 F.max(x).alias(f"{nm}_max"), F.min(x).alias(f"{nm}_min")]
    aggs += [
        fcount(fwd & _flag("P")).alias("fwd_psh_flags"), fcount(bwd & _flag("P")).alias("bwd_psh_flags"),
        fcount(fwd & _flag("U")).alias("fwd_urg_flags"), fcount(bwd & _flag("U")).alias("bwd_urg_flags"),
        fcount(_flag("F")).alias("fin_flag_cnt"), fcount(_flag("S")).alias("syn_flag_cnt"),
        fcount(_flag("R")).alias("rst_flag_cnt"), fcount(_flag("P")).alias("psh_flag_cnt"),
        fcount(_flag("A")).alias("ack_flag_cnt"), fcount(_flag("U")).alias("urg_flag_cnt"),
        fcount(_flag("E")).alias("ece_flag_cnt"),
        tcp_win(fwd).alias("init_fwd_win_byts"), tcp_win(bwd).alias("init_bwd_win_byts"),
    ]
    for d, nm in ((fwd, "fb"), (bwd, "bb")):
        aggs += [fcount(d & F.col("blk_start")).alias(f"{nm}_cnt"), dsum(F.col("blk_pkts"), d).alias(f"{nm}_pkts"),
                 dsum(F.col("blk_bytes"), d).alias(f"{nm}_bytes"), dsum(F.col("blk_us"), d).alias(f"{nm}_us")]
    if "capture" in ctx.columns:
        aggs.append(F.max(F.when(first, F.col("capture"))).alias("capture"))
    return ctx.groupBy(*FLOW_ID).agg(*aggs)


def flow_record(agg: DataFrame, active_idle: str = "gaps") -> DataFrame:
    """The 82-field record (plus ``flow_pkt``) from ``flow_aggregates``."""
    c = F.col
    dur_s = (c("last_us") - c("first_us")).cast("double") / US
    cols: dict[str, Column] = {
        "timestamp": epoch_us_to_string(c("first_us")),
        "flow_duration": dur_s,
        "flow_byts_s": F.when(c("last_us") != c("first_us"), c("len_s1").cast("double") / dur_s).otherwise(0.0),
        "flow_pkts_s": F.when(c("last_us") != c("first_us"), c("n").cast("double") / dur_s).otherwise(0.0),
        "fwd_pkts_s": F.when(c("last_us") != c("first_us"), c("nf").cast("double") / dur_s).otherwise(0.0),
        "bwd_pkts_s": F.when(c("last_us") != c("first_us"), c("nb").cast("double") / dur_s).otherwise(0.0),
        "tot_fwd_pkts": c("nf"), "tot_bwd_pkts": c("nb"),
        "totlen_fwd_pkts": c("len_f1"), "totlen_bwd_pkts": c("len_b1"),
        "fwd_pkt_len_max": F.coalesce(c("len_fmax"), F.lit(0).cast("long")),
        "fwd_pkt_len_min": F.coalesce(c("len_fmin"), F.lit(0).cast("long")),
        "fwd_pkt_len_mean": mean_of(c("nf"), c("len_f1")),
        "fwd_pkt_len_std": std_of(c("nf"), c("len_f1"), c("len_f2")),
        "bwd_pkt_len_max": F.coalesce(c("len_bmax"), F.lit(0).cast("long")),
        "bwd_pkt_len_min": F.coalesce(c("len_bmin"), F.lit(0).cast("long")),
        "bwd_pkt_len_mean": mean_of(c("nb"), c("len_b1")),
        "bwd_pkt_len_std": std_of(c("nb"), c("len_b1"), c("len_b2")),
        "pkt_len_max": c("len_max"), "pkt_len_min": c("len_min"),
        "pkt_len_mean": mean_of(c("n"), c("len_s1")),
        "pkt_len_std": std_of(c("n"), c("len_s1"), c("len_s2")),
        "pkt_len_var": var_of(c("n"), c("len_s1"), c("len_s2")),
        "fwd_header_len": c("hdr_f"), "bwd_header_len": c("hdr_b"),
        "fwd_seg_size_min": F.coalesce(c("hdr_fmin"), F.lit(0).cast("long")),
        "fwd_act_data_pkts": c("act_f"),
    }
    s = _iat_stats("flow_iat", c("iat_n"), c("iat_s1"), c("iat_s2"), c("iat_max"), c("iat_min"), False)
    cols.update(s)
    cols.update(_iat_stats("fwd_iat", c("fi_n"), c("fi_s1"), c("fi_s2"), c("fi_max"), c("fi_min"), True))
    cols.update(_iat_stats("bwd_iat", c("bi_n"), c("bi_s1"), c("bi_s2"), c("bi_max"), c("bi_min"), True))
    cols["down_up_ratio"] = safe_div(c("nb"), c("nf"))
    cols["pkt_size_avg"] = mean_of(c("n"), c("len_s1"))
    if active_idle == "gaps":
        cols.update(_iat_stats("active", c("active_us_n"), c("active_us_s1"), c("active_us_s2"),
                               c("active_us_max"), c("active_us_min"), False))
        cols.update(_iat_stats("idle", c("idle_us_n"), c("idle_us_s1"), c("idle_us_s2"),
                               c("idle_us_max"), c("idle_us_min"), False))
    else:  # "reference": the reference never records active/idle periods (Q2)
        for p in ("active", "idle"):
            for st in ("max", "min", "mean", "std"):
                cols[f"{p}_{st}"] = F.lit(0.0)
    for d, nm in (("fwd", "fb"), ("bwd", "bb")):
        cols[f"{d}_byts_b_avg"] = safe_div(c(f"{nm}_bytes"), c(f"{nm}_cnt"))
        cols[f"{d}_pkts_b_avg"] = safe_div(c(f"{nm}_pkts"), c(f"{nm}_cnt"))
        cols[f"{d}_blk_rate_avg"] = safe_div(c(f"{nm}_bytes"), c(f"{nm}_us").cast("double") / US)
    out = agg.withColumns(cols)
    out = with_record_copies(out)
    return out.select(*FLOW_ID, *_capture(out), *FLOW_COLUMNS_82)


def _capture(df: DataFrame) -> list[str]:
    """A flow's record names the capture of its first packet, where packets name theirs."""
    return [c for c in ("capture",) if c in df.columns]


def with_record_copies(df: DataFrame) -> DataFrame:
    """Duplicated feature aliases of the record."""
    return df.withColumns({
        "fwd_seg_size_avg": F.col("fwd_pkt_len_mean"), "bwd_seg_size_avg": F.col("bwd_pkt_len_mean"),
        "cwr_flag_count": F.col("fwd_urg_flags"),  # Q8: a copy of fwd URG, as in the reference
        "subflow_fwd_pkts": F.col("tot_fwd_pkts"), "subflow_bwd_pkts": F.col("tot_bwd_pkts"),
        "subflow_fwd_byts": F.col("totlen_fwd_pkts"), "subflow_bwd_byts": F.col("totlen_bwd_pkts"),
    })


def flow_features(assembled: DataFrame, active_idle: str = "gaps", fields: list[str] | None = None,
                  bucket_us: int | None = None) -> DataFrame:
    """The full 82-column record per flow. ``fields`` is B2 (unknown names ignored,
    record order kept); Catalyst prunes the aggregates of unselected fields. ``bucket_us``
    (opt-in, for hot flows) only changes how the scan is split, never the result."""
    if bucket_us is not None:  # the bucketed scan branches; read its input from a written table
        from flowlens.sources.io import materialize
        assembled = materialize(assembled, "tagged-packets")
    rec = flow_record(flow_aggregates(packet_context(assembled, bucket_us)), active_idle)
    if fields is not None:
        wanted = set(fields)
        rec = rec.select(*FLOW_ID, *_capture(rec), *[c for c in FLOW_COLUMNS_82 if c in wanted])
    return rec


# ---------------------------------------------------------------------------
# Extended statistics (not part of the 82-field record): D20-D28.
# Medians and modes are exact and never hold a flow's values in one buffer: values are
# counted per (flow, value) with partial aggregation, then ranked by a window over the
# distinct values of each flow.
# ---------------------------------------------------------------------------

def _median_mode(values: DataFrame, value_col: str, prefix: str) -> DataFrame:
    """Per flow: exact median (interpolated like numpy) and lowest most frequent value."""
    cnt = values.groupBy(*FLOW_ID, value_col).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*FLOW_ID).orderBy(value_col)
    cnt = cnt.withColumns({
        "cum": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "tot": F.sum("c").over(Window.partitionBy(*FLOW_ID)),
    })
    v = F.col(value_col)
    lo = F.min(F.when(F.col("cum") > F.floor((F.col("tot") - 1) / 2), v))
    hi = F.min(F.when(F.col("cum") > F.floor(F.col("tot") / 2), v))
    return cnt.groupBy(*FLOW_ID).agg(
        ((lo + hi).cast("double") / 2.0).alias(f"{prefix}_median"),
        F.max_by(v, F.struct(F.col("c"), -v)).alias(f"{prefix}_mode"))


def _skews(n: Column, s1: Column, s2: Column, median: Column, mode: Column, scale: float) -> dict[str, Column]:
    mean = mean_of(n, s1, scale)
    std = std_of(n, s1, s2, scale)
    return {
        "mean": mean, "std": std, "var": var_of(n, s1, s2) / F.lit(scale * scale),
        "skew": F.when(std != 0, F.lit(3.0) * (mean - median) / std).otherwise(-10.0),
        "skew2": F.when(std != 0, (mean - mode) / std).otherwise(-10.0),
        "cov": F.when(mean != 0, std / mean).otherwise(-1.0),
    }


def flow_response_times(assembled: DataFrame) -> DataFrame:
    """Times from a forward packet to the reverse packet right after it.
    Empty list sentinels: var/mean/std/mode -1, median null."""
    ctx = packet_context(assembled)
    rt = ctx.filter(F.col("resp").isNotNull()).select(*FLOW_ID, F.col("resp"))
    base = assembled.select(*FLOW_ID).distinct()
    m = rt.groupBy(*FLOW_ID).agg(F.count("resp").alias("n"), dsum(F.col("resp")).alias("s1"),
                                 sumsq(F.col("resp"), wide=True).alias("s2"))
    mm = _median_mode(rt, "resp", "rt")
    j = base.join(m, FLOW_ID, "left").join(mm, FLOW_ID, "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    med = F.col("rt_median") / US
    mode = F.col("rt_mode").cast("double") / US
    s = _skews(n, F.col("s1"), F.col("s2"), med, mode, US)
    has = n > 0
    mean = F.when(has, s["mean"]).otherwise(-1.0)
    std = F.when(has, s["std"]).otherwise(-1.0)
    mode_v = F.when(has, mode).otherwise(-1.0)
    return j.select(
        *FLOW_ID,
        F.when(has, s["var"]).otherwise(-1.0).alias("resp_var"),
        mean.alias("resp_mean"), med.alias("resp_median"), mode_v.alias("resp_mode"), std.alias("resp_std"),
        F.when(std != 0, F.lit(3.0) * (mean - med) / std).otherwise(-10.0).alias("resp_skew"),
        F.when(std != 0, (mean - mode_v) / std).otherwise(-10.0).alias("resp_skew2"),
        F.when(mean != 0, std / mean).otherwise(-1.0).alias("resp_cov"))


def flow_time_moments(assembled: DataFrame) -> DataFrame:
    """Moments of packet times relative to the flow's first packet (seconds)."""
    rel = assembled.select(*FLOW_ID, (F.col("ts_us") - F.col("flow_us")).alias("rel_us"))
    m = rel.groupBy(*FLOW_ID).agg(F.count(F.lit(1)).alias("n"), dsum(F.col("rel_us")).alias("s1"),
                                  sumsq(F.col("rel_us"), wide=True).alias("s2"))
    j = m.join(_median_mode(rel, "rel_us", "pt"), FLOW_ID)
    med, mode = F.col("pt_median") / US, F.col("pt_mode").cast("double") / US
    s = _skews(F.col("n"), F.col("s1"), F.col("s2"), med, mode, US)
    return j.select(*FLOW_ID, s["var"].alias("time_var"), s["std"].alias("time_std"),
                    s["mean"].alias("time_mean"), med.alias("time_median"), mode.alias("time_mode"),
                    s["skew"].alias("time_skew"), s["skew2"].alias("time_skew2"), s["cov"].alias("time_cov"))


def flow_length_moments(assembled: DataFrame) -> DataFrame:
    """Packet-length median, mode, skew, skew2, coefficient of variation."""
    ln = assembled.select(*FLOW_ID, F.col("frame_len"))
    m = ln.groupBy(*FLOW_ID).agg(F.count(F.lit(1)).alias("n"), dsum(F.col("frame_len")).alias("s1"),
                                 sumsq(F.col("frame_len")).alias("s2"))
    j = m.join(_median_mode(ln, "frame_len", "pl"), FLOW_ID)
    med, mode = F.col("pl_median"), F.col("pl_mode").cast("double")
    s = _skews(F.col("n"), F.col("s1"), F.col("s2"), med, mode, 1.0)
    return j.select(*FLOW_ID, med.alias("len_median"), F.col("pl_mode").alias("len_mode"),
                    s["skew"].alias("len_skew"), s["skew2"].alias("len_skew2"), s["cov"].alias("len_cov"))


def flow_first_sizes(assembled: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` packet sizes of each flow, in order (bounded by n)."""
    w = _w()
    first = assembled.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return first.groupBy(*FLOW_ID).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "frame_len"))), lambda x: x["frame_len"])
        .alias("first_sizes"))


def flow_byte_rates(assembled: DataFrame) -> DataFrame:
    """Bytes sent/received and their rates, header rates and the header
    in/out ratio; rates are -1 when the duration is 0, the ratio -1 without reverse bytes."""
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")
    H = F.col("ip_hdr_len").cast("long")
    a = assembled.groupBy(*FLOW_ID).agg(
        dsum(F.col("frame_len"), fwd).alias("bytes_sent"), dsum(F.col("frame_len"), bwd).alias("bytes_received"),
        dsum(H, fwd).alias("fwd_hdr"), dsum(H, bwd).alias("bwd_hdr"),
        F.min(F.when(fwd, H)).alias("fwd_hdr_min"), F.min(F.when(bwd, H)).alias("bwd_hdr_min"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    dur = (F.col("last_us") - F.col("first_us")).cast("double") / US
    ok = F.col("last_us") != F.col("first_us")
    rate = lambda x: F.when(ok, F.col(x).cast("double") / dur).otherwise(-1.0)
    return a.select(*FLOW_ID, "bytes_sent", "bytes_received",
                    rate("bytes_sent").alias("sent_rate"), rate("bytes_received").alias("received_rate"),
                    rate("fwd_hdr").alias("fwd_header_rate"), rate("bwd_hdr").alias("bwd_header_rate"),
                    safe_div(F.col("fwd_hdr"), F.col("bwd_hdr"), -1.0).alias("header_in_out_ratio"),
                    "fwd_hdr", "bwd_hdr", "fwd_hdr_min", "bwd_hdr_min")


def flow_initial_ttl(assembled: DataFrame) -> DataFrame:
    """TTL of the first packet (needs the optional ``ttl`` packet column)."""
    return assembled.filter(is_first() & (F.col("rep") == 0)) \
        .select(*FLOW_ID, F.col("ttl").alias("init_ttl"))


def flow_relative_times(assembled: DataFrame) -> DataFrame:
    """Relative inter-packet times, one row per packet (index 0 -> 0.0). The reference
    builds an unbounded list per flow; here it stays a long table."""
    w = _w()
    return assembled.select(
        *FLOW_ID, (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w)).cast("double") / US, F.lit(0.0)).alias("rel_time"))
