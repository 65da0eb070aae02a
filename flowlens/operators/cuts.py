"""R2/R3 as functions of the open flow, composed over segments of time.

Where a flow is cut depends on where it started, and so on every cut before it in its session. To keep
a session that never falls idle out of a single task, its packets are dealt out by segments of time. What a
segment does to the flow that is open when it begins is a step function of that flow's start: the later the start, the
later the first cut, and from there on everything is fixed. A segment's function therefore has one step for each packet that
can be the first cut, which lie in its first 120 s, and each step lists the flow starts that follow and the flow that is open at the end.

1. Every (session, segment) computes its function in one sorted pass; a session's first segment has one step, as it starts afresh.
2. The functions of ``GROUP`` neighbouring segments, counted from the session's first one, are composed to one.
3. Along each session, the composed functions give the open flow at every group's begin.
4. With that, each group walks its segments and emits the starts of the steps that hold.

Only step 1 reads packets. Steps 2 and 4 read a few rows for each segment; step 3 concerns sessions of more than one group (16 hours)
alone, and adaptive execution leaves it out where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_US = 900_000_000
GROUP = 64
FRESH = -(2**62)                      # no flow is open: the next packet starts one

SID = ["s1", "s2"]
MAPS = ("s1 long, s2 long, grp long, seg long, first boolean, upto long, exit_us long, "
        "us array<long>, pkt array<long>, ip array<string>, port array<long>")
COMPOSED = "s1 long, s2 long, grp long, first boolean, upto long, exit_us long"
ENTRIES = "s1 long, s2 long, grp long, entry_us long"
STARTS = "s1 long, s2 long, flow_us long, flow_pkt long, flow_ip string, flow_port long"


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the bounds of the groups. A group that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ends = [tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys) for i in (0, b.num_rows - 1)]
        held.append(b)
        if last is not None and ends[0] == ends[1] == last:
            continue
        last = ends[1]
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        held = table.slice(bounds[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    c = table.column(name)
    return (c.fill_null(FRESH) if c.null_count else c).to_numpy()


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = _longs(table, k)
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _steps(ts: np.ndarray, fin: np.ndarray | None, first: bool, long_us: int, fin_us: int) -> tuple[list, list, list]:
    """The step function of one segment: (latest start that it holds for, start of the flow open at the end, positions of the
    flow starts), for no open flow and then for later and later starts."""
    n = len(ts)
    if first and ts[-1] - ts[0] < min(long_us, fin_us):
        return [FRESH], [int(ts[0])], [np.zeros(1, np.int64)]
    next_fin = np.append(np.minimum.accumulate(np.where(fin, np.arange(n), n)[::-1])[::-1], n) if fin is not None else None

    def last_packet(at: np.ndarray) -> np.ndarray:
        """Position of the packet that ends the flow that starts at each position; n where it stays open."""
        e = np.maximum(np.searchsorted(ts, ts[at] + long_us, side="right"), at + 1)
        if next_fin is not None:
            e = np.minimum(e, next_fin[np.minimum(np.maximum(np.searchsorted(ts, ts[at] + fin_us), at + 1), n)])
        return e

    upto, begin = np.array([FRESH]), np.zeros(1, np.int64)
    if not first:
        # the latest start for which the packet, or one before it, ends the flow
        holds = ts - long_us - 1
        if fin is not None:
            holds = np.maximum(holds, np.maximum.accumulate(np.where(fin, ts - fin_us, FRESH)))
        some = int(np.searchsorted(holds, ts[0] - 1)) + 1
        at = np.flatnonzero(np.append(True, holds[1:some] > holds[:some - 1][:len(holds[1:some])])[:min(some, n)])
        upto, begin = np.append(upto, holds[at]), np.append(begin, at + 1)
    exit_us = np.full(len(upto), FRESH)
    now = begin.copy()
    live = np.flatnonzero(now < n)
    who, where = [live], [now[live]]
    while len(live):
        e = last_packet(now[live])
        stays = live[e >= n]
        exit_us[stays] = ts[now[stays]]
        go = e + 1 < n
        live, e = live[go], e[go]
        now[live] = e + 1
        who.append(live)
        where.append(now[live])
    order = np.argsort(np.concatenate(who), kind="stable")
    cut = np.searchsorted(np.concatenate(who)[order], np.arange(1, len(upto)))
    return upto.tolist(), exit_us.tolist(), np.split(np.concatenate(where)[order], cut)


def _segment_maps(long_us: int, fin_us: int, fin_close: bool, segment_us: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, [*SID, "seg"]):
            ts, seg, sess = (_longs(table, c) for c in ("ts_us", "seg", "sess_us"))
            fin = table.column("fin").to_numpy().astype(bool) if fin_close else None
            row, first, upto, exit_us, at, size = [], [], [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                begins = bool(sess[lo] >= seg[lo] * segment_us)
                u, x, starts = _steps(ts[lo:hi], None if fin is None else fin[lo:hi], begins, long_us, fin_us)
                row += [lo] * len(u)
                first += [begins] * len(u)
                upto += u
                exit_us += x
                size += [len(s) for s in starts]
                at += [s + lo for s in starts]
            at = np.concatenate(at)
            offset = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offset, table.column(c).take(pa.array(at)).combine_chunks()) for c in ("ts_us", "pkt_seq", "src_ip", "src_port")]
            own = table.take(pa.array(row))
            out = [own.column("s1").combine_chunks(), own.column("s2").combine_chunks(), pa.array((seg[row] - sess[row] // segment_us) // group), own.column("seg").combine_chunks(),
                   pa.array(first), pa.array(upto), pa.array(exit_us), *lists]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=[f.split()[0] for f in MAPS.split(", ")])

    return run


def _after(state: np.ndarray, upto: np.ndarray, exit_us: np.ndarray) -> np.ndarray:
    """The open flow after a map whose steps are in order, the first one for no open flow. A flow that starts later than
    every step's limit stays open."""
    at = np.searchsorted(upto, state)
    return np.where(at < len(upto), exit_us[np.minimum(at, len(upto) - 1)], state)


def _compose(group: int, reach: int):
    """Maps of a group's segments -> the group's map. A session that ends in its first group needs none; its next packet
    would be at most ``reach`` segments behind the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, [*SID, "grp"]):
            s1, s2, grp, seg, upto, exit_us = (_longs(table, c) for c in ("s1", "s2", "grp", "seg", "upto", "exit_us"))
            first = table.column("first").to_numpy().astype(bool)
            row, u_all, x_all = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if not grp[lo] and seg[hi - 1] - seg[lo] + reach < group:
                    continue
                inner = np.append(np.flatnonzero(np.append(True, seg[lo + 1:hi] != seg[lo:hi - 1])) + lo, hi)
                u, x = np.array([FRESH]), np.array([FRESH])
                for a, b in zip(inner[:-1].tolist(), inner[1:].tolist(), strict=True):
                    later = upto[a:b] > u[-1]
                    x = np.append(_after(x, upto[a:b], exit_us[a:b]), exit_us[a:b][later])
                    u = np.append(u, upto[a:b][later])
                # of neighbouring steps with one outcome the last one says it all (but none for no open flow)
                keep = np.append(x[1:] != x[:-1], True)
                keep[0] = True
                row += [lo] * int(keep.sum())
                u_all.append(u[keep])
                x_all.append(x[keep])
            if not row:
                continue
            row = np.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(s1[row]), pa.array(s2[row]), pa.array(grp[row]), pa.array(first[row]), pa.array(np.concatenate(u_all)),
                                              pa.array(np.concatenate(x_all))], names=[f.split()[0] for f in COMPOSED.split(", ")])

    return run


def _entries():
    """A session's group maps, in order -> the open flow at each later group's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, FRESH
        for table, bounds in _whole_groups(batches, [*SID, "grp"]):
            s1, s2, grp, upto, exit_us = (_longs(table, c) for c in ("s1", "s2", "grp", "upto", "exit_us"))
            at, entry = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (s1[lo], s2[lo]) != now:
                    now, state = (s1[lo], s2[lo]), FRESH
                else:
                    at.append(lo)
                    entry.append(int(state))
                state = int(_after(np.array([state]), upto[lo:hi], exit_us[lo:hi])[0])
            yield pa.RecordBatch.from_arrays([pa.array(s1[at]), pa.array(s2[at]), pa.array(grp[at]), pa.array(entry, pa.int64())],
                                             names=[f.split()[0] for f in ENTRIES.split(", ")])

    return run


def _walk():
    """Maps of a group's segments, with the open flow at its begin -> flow starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, FRESH
        for table, bounds in _whole_groups(batches, [*SID, "grp", "seg"]):
            s1, s2, grp, entry, upto, exit_us = (_longs(table, c) for c in ("s1", "s2", "grp", "entry_us", "upto", "exit_us"))
            chosen = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = (s1[lo], s2[lo], grp[lo])
                if key != now:
                    now, state = key, int(entry[lo])
                at = lo if state == FRESH else lo + int(np.searchsorted(upto[lo:hi], state))
                if at < hi:
                    chosen.append(at)
                    state = int(exit_us[at])
            rows = table.take(pa.array(chosen, pa.int64())).combine_chunks()
            flat = [pa.chunked_array([c.flatten() for c in rows.column(n).chunks], rows.column(n).type.value_type).combine_chunks() for n in ("us", "pkt", "ip", "port")]
            size = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in rows.column("us").chunks)])
            ids = [pa.array(np.repeat(_longs(rows, c), size)) for c in SID]
            yield pa.RecordBatch.from_arrays([*ids, *flat], names=[f.split()[0] for f in STARTS.split(", ")])

    return run


def flow_starts(packets: DataFrame, long_us: int, fin_us: int, fin_close: bool, idle_us: int,
                segment_us: int = SEGMENT_US, group: int = GROUP) -> DataFrame:
    """(s1, s2, sess_us, ts_us, pkt_seq, src_ip, src_port, fin) -> the first packet of every flow of the sessions (s1, s2), whose
    packets are never more than ``idle_us`` apart."""
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packets.withColumn("seg", F.floor(F.col("ts_us") / F.lit(segment_us)).cast("long"))
    dealt = dealt.repartition(*SID, "seg").sortWithinPartitions(*SID, "seg", "ts_us", "pkt_seq")
    maps = dealt.mapInArrow(_segment_maps(long_us, fin_us, fin_close, segment_us, group), MAPS)
    # read twice: both reads are of this one exchange
    maps = maps.repartition(n, *SID, "grp")
    composed = maps.sortWithinPartitions(*SID, "grp", "seg", "upto").mapInArrow(_compose(group, 1 + idle_us // segment_us), COMPOSED)
    entries = composed.repartition(*SID).sortWithinPartitions(*SID, "grp", "upto").mapInArrow(_entries(), ENTRIES)
    known = maps.join(entries, [*SID, "grp"], "left").select(*maps.columns, "entry_us")
    return known.sortWithinPartitions(*SID, "grp", "seg", "upto").mapInArrow(_walk(), STARTS)
