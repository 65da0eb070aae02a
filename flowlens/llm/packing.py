"""Best-fit packing of documents into sequences, after a dominance reduction (Martello and Toth).

1. Every document becomes pieces of at most ``capacity`` tokens; only longer ones are cut.
2. How many pieces there are of each length is all that packing needs: at most ``capacity`` counts, whatever the table's size.
3. Reduction: going down from the longest piece, a small set of pieces is fixed as one sequence for good
   when it dominates every other sequence that could hold that piece, that is, when the rest of any
   such sequence could take the places of the set's members. What is left over is packed best-fit, longest first.
4. The plan says "so many sequences of this make-up". Pieces of one length are alike, so each takes the
   place in the plan that belongs to its rank among the pieces of its length. Ranks come from counts by (input part, length).

Defined results: a null text counts as empty, and an empty text is one piece with the end token alone;
repeated rows are packed each on their own; pieces of equal length change places freely, and the order of
the input parts decides; an empty table gives an empty result; columns other than id and text are not
read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.bpe import WordBPE, vocabulary_path
from flowlens.llm.common import prepare, stored, table, texts_of

CAPACITY = 2048


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Whole if it fits; else a shorter first piece, if need be, and then full ones."""
    if n <= capacity:
        return [n]
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece, with the part of the input it came from and its index among that part's pieces
    of the same length. The result must be stored before it is used twice."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            got, ids = texts_of(b, "text"), texts_of(b, "doc_id")
            for lo in range(0, len(got), 250):
                for doc, raw in zip(ids[lo:lo + 250], bpe.encode_batch(got[lo:lo + 250]), strict=True):
                    raw += end
                    at = 0
                    for k, n in enumerate(piece_lengths(len(raw) // 4, capacity)):
                        rows.append((doc, k, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), part, seen[n]))
                        seen[n] += 1
                        at += n
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "idx"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass
class Pattern:
    """``times`` sequences, each made of ``members``: (length, how many), longest first."""
    times: int
    members: list[tuple[int, int]]
    fixed: bool


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Fix dominating sets of up to three pieces; returns them and the counts left."""
    left = counts.copy()
    out: list[Pattern] = []
    have = [int(s) for s in np.flatnonzero(left)]          # lengths that are left, ascending

    def take(members: tuple[int, ...], times: int) -> None:
        out.append(Pattern(times, sorted(((s, members.count(s)) for s in set(members)), reverse=True), True))
        for s in set(members):
            left[s] -= times * members.count(s)
            if not left[s]:
                have.remove(s)

    def largest(limit: int, without: tuple[int, ...]) -> int | None:
        """Longest piece left of at most ``limit`` tokens, when those in ``without`` are in use."""
        i = bisect.bisect_right(have, limit) - 1
        while i >= 0 and left[have[i]] <= without.count(have[i]):
            i -= 1
        return have[i] if i >= 0 else None

    def smallest(n: int, without: int) -> list[int]:
        got: list[int] = []
        for s in have:
            got += [s] * min(n - len(got), int(left[s]) - (s == without))
            if len(got) == n:
                break
        return got

    for j in [int(s) for s in np.flatnonzero(counts)[::-1]]:
        while left[j]:
            room = capacity - j
            k = largest(room, (j,))
            if k is None:                                   # nothing goes with it
                take((j,), int(left[j]))
                continue
            pair = int(left[j]) // 2 if k == j else int(min(left[j], left[k]))
            low = smallest(3, j)
            if k == room or len(low) < 2 or low[0] + low[1] > room:
                take((j, k), pair)                          # its rest fits in the place of k alone
                continue
            if len(low) == 3 and sum(low) <= room:
                break                                       # three more may fit: no rule applies
            # at most two more fit: the best of them, and the largest that a second one can be
            best, second = 0, 0
            for s in have:
                if 2 * s > room:
                    break
                other = largest(room - s, (j, s))
                if other is not None and other >= s:
                    best, second = max(best, s + other), s
            if k >= best:
                take((j, k), pair)
                continue
            b = largest(room - k, (j, k))
            if b is not None and b >= second:
                take((j, k, b), 1 if len({j, k, b}) < 3 else int(min(left[j], left[k], left[b])))
                continue
            break
    return out, left


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: sequences of like make-up are one entry, so each length costs a few steps."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}   # room -> (times, members)
    rooms: list[int] = []

    def put(room: int, times: int, members: list[tuple[int, int]]) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((times, members))

    for s in [int(x) for x in np.flatnonzero(left)[::-1]]:
        n = int(left[s])
        while n:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                times, members = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, times, members = capacity, -(-n // (capacity // s)), []
            each = room // s                                # best fit goes on filling the same sequence
            full = min(times, n // each)
            put(room - each * s, full, [*members, (s, each)])
            n -= full * each
            times -= full
            if times and n:
                put(room - n * s, 1, [*members, (s, n)])
                n, times = 0, times - 1
            if members:
                put(room, times, members)
    return [Pattern(t, m, False) for room in sorted(open_) for t, m in open_[room]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """The plan as ranges of ranks, sorted by (length, first rank): length, first rank, number in a
    sequence, first sequence, first offset."""
    rows, rank, sequence = [], {}, 0
    for p in patterns:
        at = 0
        for s, q in p.members:
            first = rank.get(s, 0)
            rows.append((s, first, q, sequence, at))
            rank[s] = first + p.times * q
            at += s * q
        sequence += p.times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity, end_id), "pieces")
    by_part = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    if not counts.any():
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32",
                          F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    given = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("idx")).alias("sequence_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, sequence, offset = given.value
        of_length = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if len(part):
                    lo, hi = of_length[n[part[0]]], of_length[n[part[0]] + 1]
                    at[part] = lo + np.searchsorted(first[lo:hi], rank[part], side="right") - 1
            inside = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[at] + inside // times[at]), pa.array(offset[at] + inside % times[at] * n)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_best_fit_packing: every document, cut and packed into sequences of 2048 tokens."""
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed sequences."""
    prepare(spark)
    return pack(docs, vocabulary_path("byte_bpe_50k.json"))
