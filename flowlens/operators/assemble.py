"""Flow assembly: packets -> bidirectional flows (operators C1-C9).

Every packet gets the identity of its flow:

* ``lo_ip, lo_port, hi_ip, hi_port`` - the unordered endpoint key (C1);
* ``flow_pkt`` - ``pkt_seq`` of the flow's first packet; ``flow_key`` - a hash of the capture (if kept apart), the endpoint
  key and the time of that packet. Both together identify the flow (C9): packets of several captures may each be numbered from 0,
  and another run over the same packets gives the same identity;
* ``flow_us`` - time of that first packet; ``is_fwd`` - direction (C2);
* ``rep`` - 0, or 1 for the repeated first row when ``first_packet_weight=2`` (C6).

Rules: R1 idle split (gap > 240 s, C3), R2 long-flow cut (the packet that makes the
duration exceed 120 s is the last of its flow, C4), R3 FIN close (a FIN packet at
duration >= 90 s closes the flow, C5). Ends are decided by event time only.

Scale notes. R1 is computed on 240 s time buckets: only the first packet of a bucket can
start a session, so the split is a partial aggregation to one row per (key, bucket), a
window over that small summary and a join back - a hot endpoint pair never lands in one
window task. R2/R3 are recursive (each cut depends on the previous flow
start); they are functions composed over segments of time (``cuts``), which emit flow starts
only; packets get their flow by an equi-join on
(session, 90 s bucket), since a bucket of that width holds at most one flow start. Flows
are then re-hashed by their identity so the feature windows and aggregates spread a hot
session over its flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.cuts import SEGMENT_US, SID, flow_starts
from flowlens.schemas import FIN_CLOSE_US, IDLE_TIMEOUT_US, LONG_FLOW_US

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port"]
FLOW_ID = ["flow_key", "flow_pkt"]
ORDER = ["ts_us", "pkt_seq", "rep"]


def tcp_udp_only(packets: DataFrame) -> DataFrame:
    """B1: keep TCP and UDP packets (pushed into the parquet scan)."""
    return packets.filter(F.col("protocol").isin(6, 17))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Unordered endpoint key (the forward lookup and the reverse lookup coincide)."""
    # struct order puts nulls first, so both directions of a packet without an address or port share a key
    src_first = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) <= \
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    out = packets.withColumns({
        "lo_ip": F.when(src_first, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "lo_port": F.when(src_first, F.col("src_port")).otherwise(F.col("dst_port")),
        "hi_ip": F.when(src_first, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "hi_port": F.when(src_first, F.col("dst_port")).otherwise(F.col("src_port")),
    })
    return out


def key_columns(key_includes_protocol: bool = False, capture_col: str | None = None) -> list[str]:
    cols = list(KEY)
    if key_includes_protocol:
        cols.append("protocol")
    if capture_col:
        cols.insert(0, capture_col)
    return cols


def identity(cols: list[str], salt: int = 0) -> Column:
    """A 64-bit hash of the columns that tells a null from a value; other salts give other hashes."""
    nulls = sum((F.col(c).isNull().cast("int") * F.lit(1 << k) for k, c in enumerate(cols)), F.lit(0))
    return F.xxhash64(F.lit(salt), nulls, *cols)


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null key values match each other (packets without an address or port stay)."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def _start_struct() -> Column:
    return F.struct(F.col("ts_us").alias("s_us"), F.col("pkt_seq").alias("s_seq"),
                    F.col("src_ip").alias("s_ip"), F.col("src_port").alias("s_port"))


def idle_sessions(packets: DataFrame, key: list[str], idle_us: int = IDLE_TIMEOUT_US) -> DataFrame:
    """C3 (R1): a gap strictly greater than ``idle_us`` starts a new session.

    Adds ``sess_us, sess_seq, sess_ip, sess_port`` (the session's first packet).

    Packets are bucketed by ``ts_us div idle_us``. Two packets of one bucket are less than
    ``idle_us`` apart, so a session can only start at the first packet of a bucket, and it
    does exactly when the previous non-empty bucket of the key ended more than ``idle_us``
    earlier. The split therefore needs one partial aggregation to a (key, bucket) summary,
    a window over that summary (a key has one row per active bucket, so a hot key stays
    small there) and one equi-join back - no window over the packets themselves.
    """
    b = packets.withColumn("sb", F.floor(F.col("ts_us") / F.lit(idle_us)).cast("long"))
    summary = b.groupBy(*key, "sb").agg(F.min(_start_struct()).alias("first"), F.max("ts_us").alias("last"))
    w = Window.partitionBy(*key).orderBy("sb")
    prev_last = F.lag("last").over(w)
    summary = summary.withColumn(
        "start", F.when(prev_last.isNull() | ((F.col("first.s_us") - prev_last) > idle_us), F.col("first")))
    summary = summary.withColumn(
        "sess", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = F.col("sess")
    return (_join_null_safe(b, summary.select(*key, "sb", "sess"), [*key, "sb"], "inner")
            .withColumns({"sess_us": s["s_us"], "sess_seq": s["s_seq"], "sess_ip": s["s_ip"], "sess_port": s["s_port"]})
            .drop("sb", "sess"))


def cut_long_flows(sessions: DataFrame, key: list[str], long_us: int = LONG_FLOW_US,
                   fin_us: int = FIN_CLOSE_US, fin_close: bool = True, segment_us: int = SEGMENT_US,
                   idle_us: int = IDLE_TIMEOUT_US) -> DataFrame:
    """C4 (R2) and C5 (R3) on top of idle sessions.

    1. ``flow_starts`` gives the first packet of every flow, by functions composed over segments of time: a session
       that never falls idle is spread over its segments.
    2. Consecutive flow starts are at least 90 s apart (120 s without FIN closes), so a
       bucket of that width holds at most one start. Each start is repeated for the few buckets
       that its flow can reach, so that a (session, bucket) knows its own start (if any) and the latest earlier
       one, and packets join it on (session, bucket): a packet belongs to
       the bucket's start when it is not before it, else to the carried one.
    """
    width = min(fin_us, long_us) if fin_close else long_us
    sid = [*key, "sess_us", "sess_seq"]
    sessions = sessions.withColumns({c: identity(sid, k) for k, c in enumerate(SID)})
    starts = flow_starts(sessions.select(*SID, "sess_us", "ts_us", "pkt_seq", "src_ip", "src_port",
                                         F.coalesce(F.col("tcp_flags"), F.lit("")).contains("F").alias("fin")),
                         long_us, fin_us if fin_close else long_us, fin_close, idle_us, segment_us)
    start = F.struct(F.col("flow_us").alias("us"), F.col("flow_pkt").alias("pkt"), F.col("flow_ip").alias("ip"), F.col("flow_port").alias("port"))
    bucket = lambda us: F.floor(us / F.lit(width)).cast("long")
    w = Window.partitionBy(*SID).orderBy("flow_us", "flow_pkt")
    starts = starts.select(*SID, start.alias("own"), F.lag(start).over(w).alias("carry"), bucket(F.col("flow_us")).alias("fb"),
                           bucket(F.lead("flow_us").over(w)).alias("next_fb"))
    # the buckets up to the next start, and no more than a flow's packets can reach
    last = F.least(F.coalesce(F.col("next_fb") - 1, F.lit(2**62)), bucket(F.col("own.us") + F.lit(long_us + idle_us)))
    summary = starts.select(*SID, F.explode(F.sequence("fb", F.greatest("fb", last))).alias("at"), "fb", "own", "carry").select(
        *SID, F.col("at").alias("fb"), F.when(F.col("at") == F.col("fb"), F.col("own")).alias("own"),
        F.when(F.col("at") == F.col("fb"), F.col("carry")).otherwise(F.col("own")).alias("carry"))
    j = sessions.withColumn("fb", bucket(F.col("ts_us"))).join(summary, [*SID, "fb"])
    mine = F.col("own").isNotNull() & (
        (F.col("ts_us") > F.col("own.us")) | ((F.col("ts_us") == F.col("own.us")) & (F.col("pkt_seq") >= F.col("own.pkt"))))
    f = F.when(mine, F.col("own")).otherwise(F.col("carry"))
    return j.withColumns({"flow_us": f["us"], "flow_pkt": f["pkt"], "flow_ip": f["ip"], "flow_port": f["port"]}) \
        .drop("fb", "own", "carry", *SID)


def assemble_flows(packets: DataFrame, long_flow_cut: bool = True, fin_close: bool = True,
                   first_packet_weight: int = 1, key_includes_protocol: bool = False,
                   capture_col: str | None = None, idle_us: int = IDLE_TIMEOUT_US,
                   long_us: int = LONG_FLOW_US, fin_us: int = FIN_CLOSE_US) -> DataFrame:
    """One row per packet (two for a weighted first packet) with its flow identity.

    ``long_flow_cut=False`` keeps R1 only (idle sessions are the flows).
    ``capture_col`` keeps captures apart (C9 separate mode); None merges them.
    """
    key = key_columns(key_includes_protocol, capture_col)
    p = with_flow_key(tcp_udp_only(packets))
    s = idle_sessions(p, key, idle_us)
    if long_flow_cut:
        f = cut_long_flows(s, key, long_us, fin_us, fin_close, idle_us=idle_us)
    else:
        f = s.withColumns({"flow_us": F.col("sess_us"), "flow_pkt": F.col("sess_seq"),
                           "flow_ip": F.col("sess_ip"), "flow_port": F.col("sess_port")})
    f = f.withColumn("flow_key", identity([*key, "flow_us"]))
    f = f.withColumn("is_fwd", F.col("src_ip").eqNullSafe(F.col("flow_ip")) & F.col("src_port").eqNullSafe(F.col("flow_port")))
    f = f.drop("sess_us", "sess_seq", "sess_ip", "sess_port", "flow_ip", "flow_port")
    return weight_first_packet(f, first_packet_weight)


def is_first() -> Column:
    """Whether a packet is its flow's first one."""
    return (F.col("pkt_seq") == F.col("flow_pkt")) & (F.col("ts_us") == F.col("flow_us"))


def weight_first_packet(flows: DataFrame, weight: int = 1) -> DataFrame:
    """Repeat the first packet of every flow ``weight`` times (reference session: 2)."""
    if weight <= 1:
        return flows.withColumn("rep", F.lit(0))
    reps = F.when(is_first(), F.sequence(F.lit(0), F.lit(weight - 1))) \
        .otherwise(F.array(F.lit(0)))
    return flows.withColumn("rep", F.explode(reps))


def flow_sessions(assembled: DataFrame) -> DataFrame:
    """Per-flow summary: oriented endpoints, first/last time, packet count."""
    first = F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol"),
                     F.struct(*ORDER))
    return (assembled.filter(F.col("rep") == 0).groupBy(*FLOW_ID)
            .agg(first.alias("h"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                 F.count(F.lit(1)).alias("n_pkts"))
            .select(F.col("h.src_ip").alias("src_ip"), F.col("h.dst_ip").alias("dst_ip"),
                    F.col("h.src_port").alias("src_port"), F.col("h.dst_port").alias("dst_port"),
                    F.col("h.protocol").alias("protocol"), "first_us", "last_us", "n_pkts"))
