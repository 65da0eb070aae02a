"""Packet sources (A1, A2).

``read_packets`` scans a packets table in any Spark format with the declared schema.

``ingest_captures`` turns a directory of capture files (pcap or pcapng) into the packets
table. A pcap file is read in ranges, so that one large capture is the work of many tasks:
Spark's text source with the line separator ``\\n`` hands out a file's bytes unchanged, in
order and split like any table. One pass in the JVM gives each range's true offset and the
file's header. Then each range looks for the first place from which a chain of plausible
record headers follows, reads its packets from there on, and hands on the bytes before that
place and those of its unfinished last record. These ends are stitched to the records that
cross ranges. A stitched piece must end exactly where the next range began; a file where it
does not (a payload may look like records) is read again from its start by one task, so the
packets never depend on the guess. Files that are no plain pcap files (pcapng, unpacked ones)
are one task's each, and at most 2 GB.

Results for odd files: bytes behind the last whole record give an error row beside the
file's packets; an unreadable file gives an error row only, a file of no bytes (Spark skips it) none; packets of a pcapng
file without a time stamp (simple packet blocks) or on an interface of an unsupported link
type are counted in an error row; frames that are not IPv4 are left out.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.schemas import PACKETS

CAPTURE_SCHEMA = T.StructType(list(PACKETS.fields) + [
    T.StructField("ttl", T.IntegerType()), T.StructField("capture", T.StringType()),
    T.StructField("error", T.StringType())])
FILE_SHIFT = 40  # pkt_seq = file index << 40 | offset of the record in the file (pcapng: number of the packet)
PIECE_SCHEMA = T.StructType(list(CAPTURE_SCHEMA.fields) + [
    T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("piece", T.BinaryType())])
WHOLE_BYTES = (1 << 31) - 1024   # the largest file that Spark reads as one value
CHAIN = 8                # plausible record headers in a row that a range starts with
SEARCH_BYTES = 4 << 20   # bytes of a range among which its first record is looked for
MAX_GAP_S = 86_400       # seconds between two packets of such a chain
ROWS_PER_BATCH = 10_000


def read_packets(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """A1: scan a packets table (one file or many; one scan either way)."""
    from flowlens.sources.io import spread
    reader = spark.read.format(fmt).options(**options)
    if fmt != "parquet":
        reader = reader.schema(PACKETS)
    df = reader.load(path if isinstance(path, str) else list(path))
    return spread(df)


_TCP_FLAGS = "FSRPAUEC"  # bit order 0..7 of the TCP flags byte (C = CWR)


def _flags(b: int) -> str:
    return "".join(ch for i, ch in enumerate(_TCP_FLAGS) if b & (1 << i))


def _parse_ip(frame: bytes, link_off: int):
    """IPv4 header fields of one frame, or None for non-IPv4 / truncated frames."""
    if link_off == 14:
        if len(frame) < 14:
            return None
        eth = struct.unpack_from("!H", frame, 12)[0]
        off = 14
        if eth == 0x8100 and len(frame) >= 18:  # VLAN tag
            eth = struct.unpack_from("!H", frame, 16)[0]
            off = 18
        if eth != 0x0800:
            return None
    else:
        off = link_off
    if len(frame) < off + 20 or frame[off] >> 4 != 4:
        return None
    ihl = (frame[off] & 0x0F) * 4
    total = struct.unpack_from("!H", frame, off + 2)[0]
    ttl, proto = frame[off + 8], frame[off + 9]
    src = ".".join(str(x) for x in frame[off + 12:off + 16])
    dst = ".".join(str(x) for x in frame[off + 16:off + 20])
    t = off + ihl
    sport = dport = window = 0
    flags = ""
    payload = 0
    if proto == 6 and len(frame) >= t + 14:
        sport, dport = struct.unpack_from("!HH", frame, t)
        doff = (frame[t + 12] >> 4) * 4
        flags = _flags(frame[t + 13])
        window = struct.unpack_from("!H", frame, t + 14)[0] if len(frame) >= t + 16 else 0
        payload = max(total - ihl - doff, 0)
    elif proto == 17 and len(frame) >= t + 8:
        sport, dport = struct.unpack_from("!HH", frame, t)
        payload = max(total - ihl - 8, 0)
    return src, dst, sport, dport, proto, ihl, payload, flags, window, ttl


def _pcap_header(head: bytes) -> tuple[str, bool, int, int]:
    """(byte order, nanoseconds, link offset, longest record) of a pcap file's first 24 bytes."""
    magic = head[:4]
    if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1"):
        endian = "<"
    elif magic in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        endian = ">"
    else:
        raise ValueError("not a pcap file")
    if len(head) < 24:
        raise ValueError("truncated pcap header")
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    snaplen, linktype = struct.unpack_from(endian + "II", head, 16)
    link_off = {1: 14, 101: 0, 228: 0}.get(linktype)
    if link_off is None:
        raise ValueError(f"unsupported link type {linktype}")
    return endian, nano, link_off, max(snaplen & 0x7FFFFFFF, 262_144)


def _whole_records(buf, pos: int, header):
    """Whole records of ``buf`` from ``pos`` on as (position, end, ts_us, original length, frame)."""
    endian, nano, _, _ = header
    record = struct.Struct(endian + "IIII")
    size = len(buf)
    while pos + 16 <= size:
        sec, frac, incl, orig = record.unpack_from(buf, pos)
        end = pos + 16 + incl
        if end > size:
            return
        yield pos, end, sec * 1_000_000 + (frac // 1000 if nano else frac), orig, bytes(buf[pos + 16:end])
        pos = end


def _first_record(buf, header) -> int | None:
    """First position from which ``CHAIN`` plausible record headers follow each other, or as many as the bytes hold."""
    endian, nano, _, longest = header
    record = struct.Struct(endian + "IIII")
    size = len(buf)

    def chain(pos: int) -> bool:
        last = None
        for _ in range(CHAIN):
            if pos + 16 > size:
                return last is not None
            sec, frac, incl, orig = record.unpack_from(buf, pos)
            if frac >= (1_000_000_000 if nano else 1_000_000) or not 0 < incl <= min(orig, longest) or orig > longest:
                return False
            if last is not None and abs(sec - last) > MAX_GAP_S:
                return False
            last, pos = sec, pos + 16 + incl
        return True

    return next((p for p in range(max(size - 15, 0)) if chain(p)), None)


def _ticks_per_second(options: bytes, endian: str) -> int:
    """Time resolution of a pcapng interface from its options (``if_tsresol``, code 9; microseconds if absent)."""
    pos = 0
    while pos + 4 <= len(options):
        code, size = struct.unpack_from(endian + "HH", options, pos)
        if code == 0:
            break
        if code == 9 and size == 1 and pos + 4 < len(options):
            v = options[pos + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
        pos += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _records_pcapng(data: bytes):
    pos, endian, link_off, tsres = 0, "<", {}, {}
    iface = untimed = unsupported = 0
    while pos + 12 <= len(data):
        btype = struct.unpack_from(endian + "I", data, pos)[0]
        if btype == 0x0A0D0D0A:
            bom = data[pos + 8:pos + 12]
            endian = "<" if bom == b"\x4d\x3c\x2b\x1a" else ">"
            iface = 0
            link_off, tsres = {}, {}
        blen = struct.unpack_from(endian + "I", data, pos + 4)[0]
        if blen < 12 or pos + blen > len(data):
            raise ValueError("truncated pcapng block")
        if btype == 1:  # interface description
            lt = struct.unpack_from(endian + "H", data, pos + 8)[0]
            link_off[iface] = {1: 14, 101: 0, 228: 0}.get(lt)
            tsres[iface] = _ticks_per_second(data[pos + 16:pos + blen - 4], endian)
            iface += 1
        elif btype == 6:  # enhanced packet block
            ifid, hi, lo, cap, orig = struct.unpack_from(endian + "IIIII", data, pos + 8)
            frame = data[pos + 28:pos + 28 + cap]
            ticks = (hi << 32) | lo
            ts_us = ticks * 1_000_000 // tsres.get(ifid, 1_000_000)
            if link_off.get(ifid) is not None:
                yield ts_us, orig, frame, link_off[ifid]
            else:
                unsupported += 1
        elif btype == 3:  # simple packet block: no time stamp
            untimed += 1
        pos += blen
    if pos < len(data):
        raise ValueError("truncated pcapng block")
    if untimed or unsupported:
        raise ValueError(f"left out: {untimed} packets without a time stamp, {unsupported} of an unsupported link type")


def _packet(seq: int, ts: int, frame: bytes, link_off: int, path: str) -> tuple | None:
    ip = _parse_ip(frame, link_off)
    if ip is None:
        return None
    src, dst, sport, dport, proto, ihl, payload, flags, window, ttl = ip
    return (seq, ts, src, dst, sport, dport, proto, ihl, payload, len(frame), flags, window, ttl, path, None,
            "packet", None, None, None)


def _mark(path: str, kind: str, block: int | None = None, offset: int | None = None, piece: bytes | None = None,
          error: str | None = None) -> tuple:
    return (None,) * (len(CAPTURE_SCHEMA) - 2) + (path, error, kind, block, offset, piece)


def _truncated(path: str, offset: int) -> tuple:
    return _mark(path, "error", error=f"ValueError: truncated record at byte {offset}")


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(PIECE_SCHEMA)


def _batches(rows, schema: pa.Schema):
    """Rows (None is skipped) as Arrow batches of at most ``ROWS_PER_BATCH`` rows."""
    chunk = []
    for r in rows:
        if r is not None:
            chunk.append(r)
        if len(chunk) >= ROWS_PER_BATCH:
            yield _batch(chunk, schema)
            chunk = []
    if chunk:
        yield _batch(chunk, schema)


def _batch(chunk: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)


def _whole_file(data: bytes, base: int, path: str):
    """Rows of a capture read from its start: packets, then an error row if something is wrong with it."""
    try:
        if data[:4] == b"\x0a\x0d\x0d\x0a":
            for i, (ts, _, frame, off) in enumerate(_records_pcapng(data)):
                yield _packet(base + i, ts, frame, off, path)
            return
        header, end = _pcap_header(data[:24]), 24
        for pos, end, ts, _, frame in _whole_records(data, 24, header):
            yield _packet(base + pos, ts, frame, header[2], path)
        if end < len(data):
            yield _truncated(path, end)
    except Exception as e:  # noqa: BLE001 - a bad file is reported, not fatal
        yield _mark(path, "error", error=f"{type(e).__name__}: {e}")


def _range_rows(lines, path: str, start: int, header, base: int, cut_last: bool):
    """Rows of one range. ``lines``: its bytes, split at \\n; ``start``: offset of its first byte in the file;
    ``cut_last``: the file does not end with \\n, so none follows the last line. Holds ``SEARCH_BYTES`` while it looks for
    the first record, afterwards one record and one batch of lines."""
    buf, at, found, skip = bytearray(), start, start == 0, 24

    def records(pos: int):
        nonlocal at
        end = pos
        for p, end, ts, _, frame in _whole_records(buf, pos, header):
            yield _packet(base + at + p, ts, frame, header[2], path)
        del buf[:end]
        at += end

    def head():
        nonlocal at, found
        pos = _first_record(buf, header)
        if pos is not None:
            found = True
            yield _mark(path, "head", start, at, bytes(buf[:pos]))
            yield from records(pos)

    for i, group in enumerate(lines):
        buf += (b"\n" if i else b"") + b"\n".join(group)
        if start == 0 and at == 0:
            if len(buf) < skip:
                continue
            yield from records(skip)
        elif found:
            yield from records(0)
        elif len(buf) >= SEARCH_BYTES:
            yield from head()
            if not found:
                yield _mark(path, "unread")
                return
    if not cut_last:
        buf += b"\n"
    if not found:
        yield from head()
    elif len(buf) >= 16:
        yield from records(24 if at == 0 else 0)
    yield _mark(path, "tail" if found else "all", start, at, bytes(buf))


def _same(batches):
    """Runs of consecutive rows of one (path, block) as (path, block, iterator of lists of lines)."""
    state = {"rows": None}

    def parts():
        for b in batches:
            paths, blocks, values = b.column(0), b.column(1), b.column(2)
            i, n = 0, b.num_rows
            ids = list(zip(paths.to_pylist(), blocks.to_pylist()))
            vals = values.to_pylist()
            while i < n:
                j = i
                while j < n and ids[j] == ids[i]:
                    j += 1
                yield ids[i], vals[i:j]
                i = j

    it = parts()
    state["rows"] = next(it, None)
    while state["rows"] is not None:
        key = state["rows"][0]

        def lines(key=key):
            while state["rows"] is not None and state["rows"][0] == key:
                group = state["rows"][1]
                yield group
                state["rows"] = next(it, None)

        run = lines()
        yield key[0], key[1], run
        for _ in run:     # what the reader left of this range
            pass


def _ranges(spark: SparkSession, path: str, glob: str):
    """(lines of all files, {file: (header, {block: true offset}, whether its last line has no \\n, last block)}) of the
    files that can be read in ranges. One row per range (128 MB by default) reaches the driver."""
    lines = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"),
        F.col("value").cast("binary").alias("value"))
    table = lines.groupBy("path", "block").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size"),
        F.min_by(F.substring("value", 1, 24), "id").alias("head")).collect()
    by_file = defaultdict(list)
    for r in table:
        by_file[r["path"]].append(r)
    ranged = {}
    for p, rows in by_file.items():
        rows.sort(key=lambda r: r["block"])
        offsets, total = {}, 0
        for r in rows:
            offsets[r["block"]] = total
            total += r["bytes"]
        head = bytes(rows[0]["head"])
        # a header that holds \\n, or bytes that Spark unpacked, are left to the whole-file reader
        if rows[0]["block"] == 0 and len(head) == 24 and total - rows[0]["size"] in (0, 1):
            try:
                ranged[p] = (_pcap_header(head), offsets, total > rows[0]["size"], rows[-1]["block"])
            except ValueError:
                pass
    return lines, ranged


def ingest_captures(spark: SparkSession, path: str, glob: str = "*.pcap*") -> tuple[DataFrame, DataFrame]:
    """A2: capture directory -> (packets, errors). Non-TCP/UDP packets are kept with their protocol so B1 can filter
    them; ``pkt_seq`` is unique across files and grows with the place in the file. Captures are parsed once, when this is
    called; both results read the stored rows."""
    from flowlens.sources.io import materialize
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    sizes = {r["p"]: r["length"] for r in listing.select(F.col("_metadata.file_path").alias("p"), "length").collect()}
    index = {p: i << FILE_SHIFT for i, p in enumerate(sorted(sizes))}
    lines, ranged = _ranges(spark, path, glob)
    known = spark.sparkContext.broadcast((index, ranged))
    schema = _arrow_schema()

    def read_ranges(batches):
        bases, files = known.value

        def rows():
            for p, block, run in _same(batches):
                if p in files:
                    header, offsets, open_end, last = files[p]
                    yield from _range_rows(run, p, offsets[block], header, bases[p], open_end and block == last)
        yield from _batches(rows(), schema)

    def read_in_order(batches):
        bases, files = known.value

        def rows():
            for p, _, run in _same(batches):
                header, _, open_end, _ = files[p]
                for r in _range_rows(run, p, 0, header, bases[p], open_end):
                    if r is None or r[-4] == "packet":
                        yield r
                    elif r[-1]:                       # the tail of the file
                        yield _truncated(p, r[-2])
        yield from _batches(rows(), schema)

    def read_files(batches):
        bases, _ = known.value
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _batches(_whole_file(content.as_py(), bases[p], p), schema)

    def stitch(key, table):
        """One chain of records across ranges: a range's tail, ranges without a first record, the next one's head."""
        bases, files = known.value
        t = table.sort_by("block")
        p, last = t["capture"][0].as_py(), t["kind"][-1].as_py()
        buf, start, header, end = b"".join(t["piece"].to_pylist()), t["offset"][0].as_py(), files[p][0], 0
        out = []
        for pos, end, ts, _, frame in _whole_records(buf, 0, header):
            out.append(_packet(bases[p] + start + pos, ts, frame, header[2], p))
        if end < len(buf):
            out = [_mark(p, "unread")] if last == "head" else [*out, _truncated(p, start + end)]
        return pa.Table.from_batches(list(_batches(out, schema)), schema)

    first = lines.select("path", "block", "value").mapInArrow(read_ranges, PIECE_SCHEMA)
    rest = [p for p in sizes if p not in ranged and sizes[p] <= WHOLE_BYTES]
    if rest:
        files = listing.select(F.col("_metadata.file_path").alias("p"), "content").filter(F.col("p").isin(rest))
        first = first.unionByName(files.repartition(len(rest), "p").mapInArrow(read_files, PIECE_SCHEMA))
    large = [_mark(p, "error", error=f"a file of {sizes[p]} bytes that is no plain pcap file")
             for p in sizes if p not in ranged and sizes[p] > WHOLE_BYTES]
    if large:
        first = first.unionByName(spark.createDataFrame(large, PIECE_SCHEMA))
    first = materialize(first, "captures")
    order = Window.partitionBy("capture").orderBy("block", F.col("kind") == "tail")   # two rows for each range
    crossing = materialize(
        first.filter(F.col("kind").isin("head", "tail", "all"))
        .withColumn("chain", F.sum((F.col("kind") == "tail").cast("int")).over(order))
        .groupBy("capture", "chain").applyInArrow(stitch, PIECE_SCHEMA), "captures")
    rows = first.unionByName(crossing)
    unread = [r["capture"] for r in rows.filter(F.col("kind") == "unread").select("capture").distinct().collect()]
    if unread:
        again = lines.filter(F.col("path").isin(unread)).repartition(len(unread), "path") \
            .sortWithinPartitions("path", "block", "id").select("path", F.lit(0).alias("block"), "value")
        rows = rows.filter(~F.col("capture").isin(unread)) \
            .unionByName(materialize(again.mapInArrow(read_in_order, PIECE_SCHEMA), "captures"))
    packets = rows.filter(F.col("kind") == "packet").select(*[f.name for f in CAPTURE_SCHEMA.fields if f.name != "error"])
    errors = rows.filter(F.col("kind") == "error").select("capture", "error")
    return packets, errors
