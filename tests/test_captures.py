"""A2: captures read in ranges hold the packets of the whole file, whatever the ranges."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.sources.packets import FILE_SHIFT, ingest_captures


def _frame(rng, payload: bytes) -> bytes:
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0,
                     bytes([10, 0, 0, rng.randrange(256)]), bytes([10, 0, 1, 10]))
    return b"\n" * 12 + b"\x08\x00" + ip + struct.pack("!HHHH", rng.randrange(65536), 53, 8 + len(payload), 0) + payload


def _records(rng, n, endian="<", payload=None):
    out = []
    for i in range(n):
        body = payload(i) if payload else rng.randbytes(rng.choice((0, 1, 40, 700, 1400)))
        frame = _frame(rng, body)
        out.append(struct.pack(endian + "IIII", 1_600_000_000 + i // 7, i % 7, len(frame), len(frame)) + frame)
    return out


def _header(endian="<", snaplen=65535):
    return struct.pack(endian + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, 1)


def _expected(records):
    """(offset, source port, payload length) of every record: plain walk over the list."""
    at, out = 24, []
    for r in records:
        out.append((at, struct.unpack_from("!H", r, 16 + 34)[0], len(r) - 16 - 42))
        at += len(r)
    return out


def _got(packets, name):
    rows = packets.filter(F.col("capture").endswith(name)).select("pkt_seq", "src_port", "payload_len").collect()
    return sorted((r["pkt_seq"] % (1 << FILE_SHIFT), r["src_port"], r["payload_len"]) for r in rows)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranges_hold_every_packet(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    little, big, odd = _records(rng, 800), _records(rng, 300, ">"), _records(rng, 50)
    long_ = _records(rng, 12, payload=lambda i: rng.randbytes(60_000 if i % 3 == 0 else 5))   # records longer than ranges
    (tmp_path / "little.pcap").write_bytes(_header() + b"".join(little))
    (tmp_path / "big one.pcap").write_bytes(_header(">") + b"".join(big))
    (tmp_path / "odd.pcap").write_bytes(_header(snaplen=0x0A0A0A) + b"".join(odd))            # \n in the header
    (tmp_path / "long.pcap").write_bytes(_header() + b"".join(long_))
    cut = b"".join(little)[:-9]
    (tmp_path / "cut.pcap").write_bytes(_header() + cut)
    (tmp_path / "bare.pcap").write_bytes(_header())
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "noise.pcap").write_bytes(rng.randbytes(50_000))
    packets, errors = ingest_captures(spark, str(tmp_path))
    packets.persist()
    for name, records in (("little.pcap", little), ("one.pcap", big), ("odd.pcap", odd), ("long.pcap", long_),
                          ("cut.pcap", little[:-1])):
        assert _got(packets, name) == _expected(records), name
    assert _got(packets, "bare.pcap") == []
    assert packets.select("pkt_seq").distinct().count() == packets.count()
    where = 24 + sum(map(len, little[:-1]))
    found = {r["capture"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert found == {"cut.pcap": f"ValueError: truncated record at byte {where}",
                     "noise.pcap": "ValueError: not a pcap file"}


def test_payloads_that_look_like_records(spark, tmp_path, small_ranges):
    """Captures within captures: a range that starts in such a payload guesses wrong, and the file is read in order."""
    rng = random.Random(2)
    inner = b"".join(struct.pack("<IIII", 1_600_000_000, 0, 20, 20) + bytes(20) for _ in range(1_600))
    records = _records(rng, 9, payload=lambda i: inner if i % 2 else rng.randbytes(30))
    (tmp_path / "nested.pcap").write_bytes(_header() + b"".join(records) + b"\n\n\n")
    packets, errors = ingest_captures(spark, str(tmp_path))
    got = [(o, s) for o, s, _ in _got(packets, "nested.pcap")]
    assert got == [(o, s) for o, s, _ in _expected(records)]
    assert [r["error"] for r in errors.collect()] == [f"ValueError: truncated record at byte {24 + sum(map(len, records))}"]


def test_pcapng_leaves_nothing_out_unsaid(spark, tmp_path):
    def block(kind, body):
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = _frame(random.Random(3), b"ab")
    frame += b"\0" * (-len(frame) % 4)
    packet = struct.pack("<IIIII", 0, 0, 5, len(frame), len(frame)) + frame
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535)) \
        + block(1, struct.pack("<HHI", 147, 0, 65535)) + block(6, packet) + block(3, struct.pack("<I", len(frame)) + frame) \
        + block(6, struct.pack("<I", 1) + packet[4:])
    (tmp_path / "a.pcapng").write_bytes(data)
    (tmp_path / "b.pcapng").write_bytes(data[:-5])
    packets, errors = ingest_captures(spark, str(tmp_path))
    assert packets.count() == 2
    assert {r["capture"][-8:]: r["error"] for r in errors.collect()} == {
        "a.pcapng": "ValueError: left out: 1 packets without a time stamp, 1 of an unsupported link type",
        "b.pcapng": "ValueError: truncated pcapng block"}


def test_folder_without_captures(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("x")
    packets, errors = ingest_captures(spark, str(tmp_path))
    assert packets.count() == 0 and errors.count() == 0
