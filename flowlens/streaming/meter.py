"""Continuous flow metering and scoring in Structured Streaming.

H1. Packets are grouped by the unordered endpoint key into ``applyInPandasWithState``.
The state of a key is O(1) - the open flow's first packet, last time and closed flag -
plus the packets not yet behind the watermark (H4: they may still be preceded by a later
arriving earlier packet, so they wait and are then applied in (ts_us, pkt_seq) order;
packets behind the watermark are dropped by Spark). The function emits every packet
tagged with its flow and a close marker when a flow ends: at the packet that cuts it
(R2/R3), at the next packet after an idle gap, or by event-time timeout once the
watermark passes last + 240 s (R1). At the end of the input nothing moves the watermark any more:
``end_of_input`` does, and so closes the flows that are left (C7).

``foreachBatch`` then appends tagged packets to a parquet table partitioned by event hour
and computes the 82 features of the flows closed in the batch with the batch operator
(``flow_features``), reading only the hours those flows span - so a stream and a batch run
over the same packets give the same records. Writes are per ``batch_id`` and overwrite,
so a replayed batch is idempotent.
"""

from __future__ import annotations

import os
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from flowlens.operators.assemble import KEY, identity, tcp_udp_only, weight_first_packet, with_flow_key
from flowlens.operators.features import flow_features
from flowlens.schemas import FIN_CLOSE_US, IDLE_TIMEOUT_US, LONG_FLOW_US, PACKETS

HOUR_US = 3_600_000_000
#: Port of the marker packet that ``end_of_input`` writes; no real packet has it.
END_PORT = -1

STATE_SCHEMA = T.StructType([
    T.StructField("buf", T.BinaryType()),
    T.StructField("open", T.BooleanType()),
    T.StructField("f_us", T.LongType()), T.StructField("f_seq", T.LongType()),
    T.StructField("f_ip", T.StringType()), T.StructField("f_port", T.LongType()),
    T.StructField("last_us", T.LongType()), T.StructField("closed", T.BooleanType()),
])

TAGGED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c.endswith("ip") else T.LongType()) for c in KEY]
    + list(PACKETS.fields)
    + [T.StructField("flow_pkt", T.LongType()), T.StructField("flow_us", T.LongType()),
       T.StructField("is_fwd", T.BooleanType()), T.StructField("kind", T.StringType()),
       T.StructField("closed_us", T.LongType())])


def known(v):
    """None for any of the ways in which a frame says that there is no value."""
    return None if pd.isna(v) else v


def port(v) -> int | None:
    return None if pd.isna(v) else int(v)


def _meter_fn(idle_us: int, long_us: int, fin_us: int, fin_close: bool):
    pcols = [f.name for f in PACKETS.fields]
    out_cols = [f.name for f in TAGGED_SCHEMA.fields]

    def fn(key, pdfs, state):
        if state.exists:
            buf_b, is_open, f_us, f_seq, f_ip, f_port, last_us, closed = state.get
            buf = pickle.loads(buf_b) if buf_b else pd.DataFrame(columns=pcols)
        else:
            buf, is_open, f_us, f_seq, f_ip, f_port, last_us, closed = (
                pd.DataFrame(columns=pcols), False, None, None, None, None, None, False)
        new = [p[pcols] for p in pdfs if len(p)]
        if new:
            buf = pd.concat([buf] + new, ignore_index=True) if len(buf) else pd.concat(new, ignore_index=True)
        wm = state.getCurrentWatermarkMs() * 1000
        ready = buf[buf["ts_us"] <= wm].sort_values(["ts_us", "pkt_seq"]) if len(buf) else buf
        buf = buf[buf["ts_us"] > wm] if len(buf) else buf
        rows = []

        def close(at_us):
            rows.append({**dict(zip(KEY, key)), "flow_pkt": f_seq, "flow_us": f_us, "kind": "close",
                         "closed_us": at_us})

        for rec in ready.itertuples(index=False):
            r = rec._asdict()
            ts = int(r["ts_us"])
            if is_open and (closed or ts - last_us > idle_us):
                if not closed:
                    close(last_us)
                is_open = False
            if not is_open:
                is_open, closed = True, False
                f_us, f_seq, f_ip, f_port = ts, int(r["pkt_seq"]), known(r["src_ip"]), port(r["src_port"])
            else:
                fin = fin_close and "F" in (known(r["tcp_flags"]) or "")
                if ts - f_us > long_us or (fin and ts - f_us >= fin_us):
                    closed = True
            last_us = ts
            rows.append({**dict(zip(KEY, key)), **r, "flow_pkt": f_seq, "flow_us": f_us,
                         "is_fwd": known(r["src_ip"]) == f_ip and port(r["src_port"]) == f_port, "kind": "pkt"})
            if closed:
                close(ts)
        if is_open and (closed or wm - last_us > idle_us):
            if not closed:
                close(last_us)
            is_open, closed = False, False
        if not is_open and len(buf) == 0:
            state.remove()
        else:
            state.update((pickle.dumps(buf) if len(buf) else None, is_open, f_us, f_seq, f_ip, f_port, last_us, closed))
            nxt = [last_us + idle_us + 1] if is_open else []
            if len(buf):
                nxt.append(int(buf["ts_us"].max()))
            state.setTimeoutTimestamp(max(int(min(nxt)) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            out = pd.DataFrame(rows).reindex(columns=out_cols)
            for f in TAGGED_SCHEMA.fields:
                if isinstance(f.dataType, T.LongType):
                    out[f.name] = out[f.name].astype("Int64")
                elif isinstance(f.dataType, T.IntegerType):
                    out[f.name] = out[f.name].astype("Int32")
                elif isinstance(f.dataType, T.BooleanType):
                    out[f.name] = out[f.name].astype("boolean")
            yield out

    return fn


def meter_stream(packets: DataFrame, watermark: str = "1 minute", idle_us: int = IDLE_TIMEOUT_US,
                 long_us: int = LONG_FLOW_US, fin_us: int = FIN_CLOSE_US, fin_close: bool = True,
                 control: DataFrame | None = None) -> DataFrame:
    """H1: streaming packets -> tagged packets and flow close markers (see module doc). ``control``: a stream of end markers."""
    cols = [f.name for f in PACKETS.fields]
    packets = tcp_udp_only(packets).select(*cols)
    if control is not None:
        packets = packets.unionByName(control.select(*cols))
    p = with_flow_key(packets).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)
    cols = [*KEY, *[f.name for f in PACKETS.fields]]
    tagged = p.select(*cols, "ts").groupBy(*KEY).applyInPandasWithState(
        _meter_fn(idle_us, long_us, fin_us, fin_close), TAGGED_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    return tagged.filter(F.coalesce(F.col("lo_port"), F.lit(0)) != END_PORT)


def end_of_input(spark: SparkSession, in_dir: str, control_dir: str, margin_us: int = 86_400_000_000) -> None:
    """Declare that no more packets will come to the parquet folder ``in_dir``.

    Writes one marker packet, ``margin_us`` after the last packet there, to ``control_dir``, which ``start_metering`` reads as a second
    stream; the packets' own folder stays as it is. The running query (or its next ``availableNow`` start on the same checkpoint)
    moves its watermark past every packet, applies those that wait and closes every open flow; the marker itself is not part
    of the output. Packets that arrive afterwards are late.
    ``margin_us`` must exceed the watermark delay plus the idle timeout. An empty folder needs no marker."""
    last = spark.read.schema(PACKETS).parquet(in_dir).agg(F.max("ts_us")).first()[0]
    if last is None:
        return
    marker = {f.name: None for f in PACKETS.fields} | {
        "pkt_seq": -1, "ts_us": last + margin_us, "src_ip": "", "dst_ip": "", "src_port": END_PORT, "dst_port": END_PORT,
        "protocol": 6, "tcp_flags": ""}
    row = tuple(0 if marker[f.name] is None and not isinstance(f.dataType, T.StringType) else marker[f.name] for f in PACKETS.fields)
    spark.createDataFrame([row], PACKETS).write.mode("append").parquet(control_dir)


def flows_batch_writer(tagged_path: str, flows_path: str, first_packet_weight: int = 1, active_idle: str = "gaps"):
    """foreachBatch body for ``meter_stream``: store tagged packets, emit closed flows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # read twice below; do not re-run the stateful step
        try:
            _write(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def _write(spark, batch: DataFrame, batch_id: int) -> None:
        pk = batch.filter(F.col("kind") == "pkt").drop("kind", "closed_us") \
            .withColumn("flow_key", identity([*KEY, "flow_us"])) \
            .withColumn("hour", F.floor(F.col("ts_us") / F.lit(HOUR_US)).cast("long"))
        pk.write.mode("overwrite").partitionBy("hour").parquet(f"{tagged_path}/batch_id={batch_id}")
        closed = batch.filter(F.col("kind") == "close").select(identity([*KEY, "flow_us"]).alias("flow_key"), "flow_pkt", "flow_us", "closed_us")
        span = closed.agg(F.min("flow_us").alias("lo"), F.max("closed_us").alias("hi")).collect()[0]
        if span["lo"] is None:
            return
        lo_h, hi_h = span["lo"] // HOUR_US, span["hi"] // HOUR_US
        stored = spark.read.option("basePath", tagged_path).parquet(tagged_path) \
            .filter((F.col("hour") >= lo_h) & (F.col("hour") <= hi_h))
        mine = stored.join(closed.select("flow_key", "flow_pkt"), ["flow_key", "flow_pkt"], "left_semi").drop("hour", "batch_id")
        rec = flow_features(weight_first_packet(mine, first_packet_weight), active_idle)
        rec.write.mode("overwrite").parquet(f"{flows_path}/batch_id={batch_id}")

    return write


def start_metering(spark: SparkSession, packets_stream: DataFrame, out_dir: str, checkpoint: str,
                   watermark: str = "1 minute", trigger: dict | None = None, control_dir: str | None = None, **meter_kw):
    """H1 end to end: returns the running StreamingQuery writing ``out_dir/{tagged,flows}``. ``control_dir`` is an existing folder, given
    from the first start on, to which ``end_of_input`` writes."""
    tagged = meter_stream(packets_stream, watermark, control=control_dir and spark.readStream.schema(PACKETS).parquet(control_dir), **meter_kw)
    w = tagged.writeStream.foreachBatch(flows_batch_writer(os.path.join(out_dir, "tagged"),
                                                           os.path.join(out_dir, "flows"))) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def start_csv_scoring(spark: SparkSession, in_dir: str, model, out_dir: str, checkpoint: str,
                      trigger: dict | None = None, max_files_per_trigger: int = 100, rejects_dir: str | None = None):
    """H3: flow CSV files arriving in ``in_dir`` -> features -> scores -> A8 sink, each row with its flow's identity, its file and
    the prediction in lower case. Lines of a wrong width go to ``rejects_dir`` (``out_dir`` with ``_rejected`` behind it)."""
    from flowlens.operators.records import IDENTITY, csv_events_to_features, csv_prediction, drop_header_rows, split_by_width
    from flowlens.sources.flowcsv import stream_flows_csv, write_scored_batch
    ev = stream_flows_csv(spark, in_dir, max_files_per_trigger)
    rejects = f"{(rejects_dir or out_dir.rstrip('/') + '_rejected').rstrip('/')}"

    def sink(batch, batch_id):
        feats = csv_events_to_features(batch, keep=["source_file", *IDENTITY], features=model.features)
        write_scored_batch(csv_prediction(model.transform(feats)), batch_id, out_dir)
        bad = split_by_width(drop_header_rows(batch))[1]
        bad.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    w = ev.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
