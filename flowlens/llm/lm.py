"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, ``1 + floor(log_b(count))``, and an n-gram of level q is put
into a Bloom filter q times, as (n-gram, 1) to (n-gram, q). A count is read back by probing
(n-gram, 1), (n-gram, 2), ... until one is missing; the last hit's level stands for the mean count of that level.
A word's probability mixes the pair's relative frequency with the smoothed frequency of the word alone. The weight is
picked from a grid by the likelihood of all training text, each pair counted without itself (leave one out).

Flow: (1) the tasks send the n-grams of training texts, counted, as packed blocks to segments by hash. (2) A segment adds them up and stores
its piece: the bits of its n-grams, and the exact counts of its words, which the base score needs. (3) While all pieces together take at most
``broadcast_bytes``, which is checked before anything is collected, they are broadcast to the workers, and texts are scored as they are
scanned. Beyond that, texts are packed and stored in blocks of about ``part_bytes`` at most; a block sends its distinct n-grams, ascending, to the
segments, which probe their pieces for them, and gets the levels back in the same order, without the n-grams, which it finds again. Both ways probe
the same bits in the same manner, level by level, so scores are equal. The second way removes its blocks and answers when the scores are stored, and
all shuffle files of n-grams go when their step has ended.
Every n-gram has ``bits`` bits whatever the size of the input, and the number of segments follows the input. Memory of a task: ``flush`` tokens in (1),
the n-grams of a segment, twice, in (2), the pieces or the distinct n-grams of a block in (3), besides a batch of texts.

Defined results: a null text counts as empty (one token, the end); repeated rows count and are scored each; rows with a null id are
in training by the hash of the empty id; an empty table gives an empty result; other columns are not read; a very long text is counted and scored whole,
in a batch of its own. Words and pairs are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import crc_mod, discard, mix64, prepare, shared_path, stored, table

U = np.uint64
END = U(0x243F6A8885A308D3)                                 # the hash that stands for the end of a text
GRID = (0.01, 0.05, 0.15, 0.3, 0.5, 0.7)


@dataclass(frozen=True)
class LMParams:
    base: float = 1.5              # of the levels
    bits: int = 10                 # of the filter for each entry
    hashes: int = 4
    segment_bytes: int = 16 << 20  # input text for each segment
    broadcast_bytes: int = 192 << 20   # most that is broadcast: the filter's bits, and 16 bytes for each word
    part_bytes: int = 16 << 20     # most text of a block, about, where the filter is not broadcast
    flush: int = 1_000_000         # tokens that a task counts before it sends them; a block of texts has about as many at most
    cache_words: int = 100_000     # not used: words are numbered block by block


def levels(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9).astype(np.int64)


def level_values(base: float) -> np.ndarray:
    """Mean of the whole numbers of each level, up to that of any 64-bit count; level 0 is a count of 0."""
    out, n = [0.0], int(levels(np.array([2**63 - 1]), base)[0]) + 1
    for j in range(1, n):
        lo, hi = np.ceil(base ** (j - 1) - 1e-9), np.ceil(base**j - 1e-9) - 1
        out.append(float(lo + hi) / 2 if hi >= lo else float(base ** (j - 0.5)))
    return np.array(out)


def chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts, of about ``most`` bytes or one text; a text counts 8 bytes more, as its end is a token."""
    size, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, an end after each text, as numbers of words; words of each text; and the words' hashes, ascending, among them END.
    Only A to Z are lower-cased, and only ASCII white space parts words."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    some = pc.greater(pc.binary_length(trimmed), 0)
    split = pc.ascii_split_whitespace(trimmed.filter(some))
    n = np.zeros(len(texts), np.int64)
    n[some.to_numpy(zero_copy_only=False)] = split.value_lengths().to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    found = coded.dictionary
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found.cast(pa.binary())), b" ")[0].as_py()
    word, number = np.unique(np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, joined.split()), U, len(found)), END), return_inverse=True)
    return np.insert(number[coded.indices.to_numpy()], np.cumsum(n), number[-1]), n, word


def before_each(x: np.ndarray, end) -> np.ndarray:
    """In front of each token the one before it (an end, at the start). Texts end with an end."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[:1] = end
    return out


def pairs_of(ids: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = word[ids]
    return pair_hash(before_each(h, END), h)


def ascending(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different hashes, and where each starts among all of them, sorted."""
    h = np.sort(h)
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[start], start


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different hashes, and the number of each one's among them. Sorts by the first bits, with places in the last ones."""
    bits = U(max(len(h) - 1, 1).bit_length())
    at = (np.sort(h >> bits << bits | np.arange(len(h), dtype=U)) & ((U(1) << bits) - U(1))).astype(np.int64)
    s = h[at]
    if (s[1:] < s[:-1]).any():              # hashes with the same first bits
        return np.unique(h, return_inverse=True)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(h), np.int64)
    back[at] = np.cumsum(new) - 1
    return s[new], back


def pair_hash(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64((before * U(0x9E3779B97F4A7C15)) ^ (h + U(0x632BE59BD9B4E019)))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (((h >> U(32)) * U(segments)) >> U(32)).astype(np.int64)


def entry_key(h: np.ndarray, kind: int) -> np.ndarray:
    """The key of a word (kind 0) or of a pair (kind 1)."""
    return mix64(h ^ (U(kind) * U(0xD6E8FEB86659FD93)))


def two_hashes(key: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of (n-gram, level): the first hash, and what is added for each further one, modulo 2^32."""
    step = 0x9E3779B97F4A7C15
    a = mix64(key + (level.astype(U) * U(step) if isinstance(level, np.ndarray) else U(level * step % 2**64)))
    return a >> U(32), (a & U(0xFFFFFFFF)) | U(1)


def place(high: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The bit of a hash in a piece of ``size`` bits."""
    return ((high * (size.astype(U) if isinstance(size, np.ndarray) else U(size))) >> U(32)).view(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns, compressed byte plane by byte plane."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    wide = [np.dtype(t).itemsize for t in types]
    raw, at, out = np.frombuffer(pa.decompress(data, n * sum(wide), codec="zstd", asbytes=True), np.uint8), 0, []
    for t, w in zip(types, wide, strict=True):
        out.append(np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def squeeze(key: np.ndarray, *more: np.ndarray) -> bytes:
    """An ascending column, as differences, and others beside it."""
    return pack(np.diff(key, prepend=np.zeros(1, key.dtype)), *more)


def expand(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    out = unpack(data, n, *types)
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def make_bits(key: np.ndarray, level: np.ndarray, p: LMParams) -> tuple[np.ndarray, int]:
    """The bits of a piece that holds each key at levels 1 to ``level``: packed, with their number."""
    size = max(int(level.sum()) * p.bits, 64)
    table = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        high, low = two_hashes(key[level >= j], j)
        for _ in range(p.hashes):
            table[place(high, size)] = True
            high = (high + low) & U(0xFFFFFFFF)
    return np.packbits(table, bitorder="little"), size


class Pieces:
    """The filter's pieces ``first``, ``first`` + 1, ..., to be probed."""

    def __init__(self, bits: np.ndarray, offset: np.ndarray, size: np.ndarray, top: np.ndarray, segments: int, hashes: int, first: int = 0):
        self.bits, self.offset, self.size, self.top = bits, offset, size, top      # offsets in bits
        self.segments, self.hashes, self.first = segments, hashes, first

    @classmethod
    def one(cls, seg: int, bits: bytes, size: int, top: int, segments: int, hashes: int) -> Pieces:
        return cls(np.frombuffer(bits, np.uint8), np.zeros(1, np.int64), np.array([size]), np.array([top]), segments, hashes, seg)

    def level(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Level of each n-gram: probe (n-gram, 1), (n-gram, 2), ... until one is not there. Segments ascend; they are probed one by one, in runs
        that stay in a processor's cache, and the few n-grams of high levels together."""
        out, rest, run, few = np.zeros(len(h), "<u2"), [], 1 << 15, 300
        for seg, a, b in by_segment(h, self.segments):
            k = seg - self.first
            offset, size, top = int(self.offset[k]), int(self.size[k]), int(self.top[k])
            for lo in range(a, b, run):
                live, level = np.arange(lo, min(lo + run, b)), 0
                key = entry_key(h[lo:lo + len(live)], kind)
                while level < top and len(live) > few:
                    level += 1
                    hit = self.there(key, level, size, offset)
                    live, key = live[hit], key[hit]
                    out[live] = level
                if level < top:
                    rest.append(live)
        live = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        key, seg = entry_key(h[live], kind), segment_of(h[live], self.segments) - self.first
        while len(live):
            level = out[live] + 1
            some = np.flatnonzero(level <= self.top[seg])
            hit = some[self.there(key[some], level[some], self.size[seg[some]], self.offset[seg[some]])]
            live, key, seg = live[hit], key[hit], seg[hit]
            out[live] = level[hit]
        return out

    def there(self, key: np.ndarray, level: np.ndarray | int, size: np.ndarray | int, offset: np.ndarray | int) -> np.ndarray:
        """Which of (n-gram, level) have all their bits; level, size and offset are one for all or each one's."""
        (high, low), at = two_hashes(key, level), np.arange(len(key))
        for k in range(self.hashes):
            bit = place(high, size) + offset
            hit = np.flatnonzero(((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8(1)).view(bool))
            if len(hit) < len(high):
                high, low, at = high[hit], low[hit], at[hit]
                size, offset = (x[hit] if isinstance(x, np.ndarray) else x for x in (size, offset))
            if k < self.hashes - 1:
                high = (high + low) & U(0xFFFFFFFF)
        return at


def by_segment(h: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, from, to) of ascending hashes."""
    cut = np.searchsorted(segment_of(h, segments), np.arange(segments + 1))
    for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        yield s, int(cut[s]), int(cut[s + 1])


def add_equal(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different hashes, and the sums of their counts."""
    order = np.argsort(h)
    h, c = h[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[start], np.add.reduceat(c, start) if len(h) else c


def record(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


COUNTED = "seg int, kind int, n long, data binary"


def count_ngrams(texts: DataFrame, segments: int, p: LMParams) -> DataFrame:
    """(text) -> counts of the n-grams, packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, total = [], [], 0

        def emit() -> pa.RecordBatch:
            w, wc = add_equal(*(np.concatenate(x) for x in zip(*words, strict=True)))
            g, start = ascending(np.concatenate(pairs))
            gc = np.diff(start, append=total)
            words.clear()
            pairs.clear()
            return record([(s, kind, b - a, squeeze(h[a:b].astype("<u8"), c[a:b].astype("<u4"))) for kind, (h, c) in enumerate(((w, wc), (g, gc)))
                           for s, a, b in by_segment(h, segments)], COUNTED)

        for batch in batches:
            texts = batch.column(0)
            for lo, hi in chunks(texts, 4 * p.flush):
                ids, _, word = read_words(texts.slice(lo, hi - lo))
                c = np.bincount(ids, minlength=len(word))
                words.append((word[c > 0], c[c > 0]))
                pairs.append(pairs_of(ids, word))
                total += len(ids)
                if total >= p.flush:
                    yield emit()
                    total = 0
        if total:
            yield emit()

    return texts.select("text").mapInArrow(run, COUNTED)


PIECE = "seg int, tokens long, types long, entries long, size long, top int, words binary, bits binary"


def make_pieces(counted: DataFrame, segments: int, p: LMParams) -> DataFrame:
    """Packed counts -> each segment's piece of the filter, and its words with their counts."""

    def piece(seg: int, blocks: tuple[list, list]) -> pa.RecordBatch:
        (w, wc), (g, gc) = (add_equal(np.concatenate([h for h, _ in x] or [np.zeros(0, U)]), np.concatenate([c for _, c in x] or [np.zeros(0, np.int64)])) for x in blocks)
        level = levels(np.concatenate([wc, gc]), p.base)
        bits, size = make_bits(np.concatenate([entry_key(w, 0), entry_key(g, 1)]), level, p)
        return record([(seg, int(wc.sum()), len(w), int(level.sum()), size, int(level.max(initial=0)), squeeze(w.astype("<u8"), wc.astype("<u8")), bits.tobytes())], PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, new = None, ([], []), [0, 0]
        for b in batches:
            for seg, kind, n, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("seg", "kind", "n", "data")), strict=True):
                if seg != now:
                    if now is not None:
                        yield piece(now, blocks)
                    now, blocks, new = seg, ([], []), [0, 0]
                h, c = expand(data, n, "<u8", "<u4")
                blocks[kind].append((h, c.astype(np.int64)))
                new[kind] += n
                # equal n-grams are added up when as many have come as were left the last time, so that work follows the input
                if len(blocks[kind]) > 1 and new[kind] >= max(1 << 18, len(blocks[kind][0][0])):
                    blocks[kind][:] = [add_equal(*(np.concatenate(x) for x in zip(*blocks[kind], strict=True)))]
                    new[kind] = 0
        if now is not None:
            yield piece(now, blocks)

    return counted.repartition(segments, "seg").sortWithinPartitions("seg").mapInArrow(run, PIECE)


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"


class Scorer:
    """Scores batches of texts with the counts and levels that ``lookup`` finds for ascending hashes: of words (counts, levels) and of pairs (levels)."""

    def __init__(self, words, pairs, tokens: int, types: int, p: LMParams):
        self.words, self.pairs = words, pairs
        self.value, self.smooth = level_values(p.base), tokens + 0.5 * (types + 1)
        self.most = 4 * p.flush

    def blocks(self, ids: pa.Array, train: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(texts, self.most):
            yield self.block(*(x.slice(lo, hi - lo) for x in (ids, train, texts)))

    def block(self, doc_id: pa.Array, train: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, n, word = read_words(texts)
        start = np.cumsum(n + 1) - n - 1
        count, level = self.words(word)
        pair, back = distinct(pairs_of(ids, word))
        one, two = level.astype(np.int64)[ids], self.pairs(pair).astype(np.int64)[back]
        # a token's probability depends on three levels: its own, that of the word before, and the pair's
        high = 1 + max(int(one.max(initial=0)), int(two.max(initial=0)))
        code = (one * high + before_each(one, level[np.searchsorted(word, END)])) * high + two
        used = np.flatnonzero(np.bincount(code, minlength=high**3))
        number = np.zeros(high**3, np.int64)
        number[used] = np.arange(len(used))
        code = number[code]
        hist = self.value[used // high % high]
        two = np.minimum(self.value[used % high], hist)
        single = (self.value[used // high // high] + 0.5) / self.smooth
        share = two / np.maximum(hist, 1)
        less = np.maximum(two - 1, 0) / np.maximum(hist - 1, 1)
        own = np.array(train)
        score, out = [], []
        for w in GRID:
            score.append(np.add.reduceat(np.log10(w * share + (1 - w) * single)[code], start))
            out.append(np.where(own, np.add.reduceat(np.log10(w * less + (1 - w) * single)[code], start), 0))
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * len(x[0]) + 1, len(x), dtype=np.int32)), pa.array(np.stack(x, 1).ravel()))
        base = np.add.reduceat(np.log10(count + 0.5)[ids], start) - (n + 1) * np.log10(self.smooth)
        return pa.RecordBatch.from_arrays([doc_id, train, pa.array(n + 1), pa.array(np.add.reduceat((count > 0).astype(np.int64)[ids], start)), pa.array(base), flat(score), flat(out)],
                                          names=[f.split()[0] for f in SCORED.split(", ")])


def counts_of(h: np.ndarray, words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Exact counts, 0 for words that are not among the ascending ones."""
    at = np.searchsorted(words, h)
    hit = at < len(words)
    hit[hit] = words[at[hit]] == h[hit]
    out = np.zeros(len(h), np.int64)
    out[hit] = count[at[hit]]
    return out


def score_broadcast(rows: DataFrame, pieces: DataFrame, segments: int, tokens: int, types: int, p: LMParams) -> DataFrame:
    """Scores of (doc_id, train, text), with all pieces in every worker. The caller has checked their size."""
    # filled in one piece at a time: the driver never holds the pieces twice
    sizes = {r["seg"]: r for r in pieces.select("seg", "types", "size", "top", F.octet_length("bits").alias("octets")).collect()}
    of = lambda field, none: np.array([sizes[s][field] if s in sizes else none for s in range(segments)], np.int64)
    octets, types_ = of("octets", 0), of("types", 0)
    at, word_at = np.cumsum(octets) - octets, np.cumsum(types_) - types_
    bits = np.zeros(int(octets.sum()) + 1, np.uint8)
    word, count = np.zeros(int(types_.sum()), U), np.zeros(int(types_.sum()), np.int64)
    for r in pieces.select("seg", "types", "words", "bits").toLocalIterator():
        seg, n = r["seg"], r["types"]
        bits[at[seg]:at[seg] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        word[word_at[seg]:word_at[seg] + n], count[word_at[seg]:word_at[seg] + n] = expand(r["words"], n, "<u8", "<u8")
    table = Pieces(bits, at * 8, of("size", 64), of("top", 0), segments, p.hashes)
    given = rows.sparkSession.sparkContext.broadcast((table, word, count))
    del table, bits, word, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, word, count = given.value
        scorer = Scorer(lambda h: (counts_of(h, word, count), table.level(h, 0)), lambda h: table.level(h, 1), tokens, types, p)
        for b in batches:
            yield from scorer.blocks(*b.columns)

    out = stored(rows.select("doc_id", "train", "text").mapInArrow(run, SCORED), "lm-scores")
    given.destroy()
    return out


BLOCK = "block long, data binary"
ANSWER = "block long, side int, seg int, n long, data binary"


def packed(rows: DataFrame, p: LMParams) -> DataFrame:
    """(doc_id, train, text) -> blocks of rows, compressed."""
    most = min(p.part_bytes, 8 * p.flush)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for b in held:
                    to.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

        for b in batches:
            texts = b.column(2)
            for lo, hi in chunks(texts, most):
                more = (pc.sum(pc.binary_length(texts.slice(lo, hi - lo))).as_py() or 0) + 8 * (hi - lo)
                if held and size + more > most:
                    yield emit()
                    made, held, size = made + 1, [], 0
                held.append(b.slice(lo, hi - lo))
                size += more
        if held:
            yield emit()

    return rows.select("doc_id", "train", "text").mapInArrow(run, BLOCK)


def unpacked(data: bytes) -> list[pa.Array]:
    return [pa.concat_arrays(c.chunks) for c in pa.ipc.open_stream(data).read_all().columns]


def score_by_segment(rows: DataFrame, pieces: DataFrame, segments: int, tokens: int, types: int, p: LMParams) -> DataFrame:
    """Scores of (doc_id, train, text), with the n-grams of each block sent to the segments and answered there."""
    spark = rows.sparkSession
    blocks, blocks_path = kept(packed(rows, p), "lm-docs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, _, word = read_words(unpacked(data.as_py())[2])
                yield record([(block, side, s, hi - lo, squeeze(h[lo:hi].astype("<u8"))) for side, h in enumerate((word, ascending(pairs_of(ids, word))[0]))
                              for s, lo, hi in by_segment(h, segments)], ANSWER)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = table = word = count = None
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in b.schema.names}
            out, k = [], 0
            while k < len(col["seg"]):
                seg, side, last = col["seg"][k], col["side"][k], k + 1
                if seg != now:
                    now, table = seg, Pieces.one(seg, b"", 64, 0, segments, p.hashes)
                    word, count = np.zeros(0, U), np.zeros(0, np.int64)
                if side < 0:
                    table = Pieces.one(seg, col["bits"][k], col["size"][k], col["top"][k], segments, p.hashes)
                    word, count = expand(col["data"][k], col["n"][k], "<u8", "<u8")
                else:                                           # of several blocks at once
                    while last < len(col["seg"]) and (col["seg"][last], col["side"][last]) == (seg, side):
                        last += 1
                    h = np.concatenate([expand(col["data"][x], col["n"][x], "<u8")[0] for x in range(k, last)])
                    level, at = table.level(h, side), 0
                    found = (level,) if side else (counts_of(h, word, count.astype(np.int64)).astype("<u8"), level)
                    for x in range(k, last):
                        n = col["n"][x]
                        out.append((col["block"][x], side, seg, n, pack(*(f[at:at + n] for f in found))))
                        at += n
                k = last
            yield record(out, ANSWER)

    asked = blocks.mapInArrow(ask, ANSWER)
    null = F.lit(None)
    both = pieces.select("seg", F.lit(-1).alias("side"), F.lit(-1).cast("long").alias("block"), F.col("types").alias("n"), "size", "top", F.col("words").alias("data"), "bits").unionAll(
        asked.select("seg", "side", "block", "n", null.cast("long"), null.cast("int"), "data", null.cast("binary")))
    answers, answers_path = kept(both.repartition(segments, "seg").sortWithinPartitions("seg", "side").mapInArrow(answer, ANSWER), "lm-answers")

    # each block's answers, in the order of its n-grams, and then its texts
    laid = answers.unionAll(blocks.select("block", F.lit(2).alias("side"), F.lit(0).alias("seg"), F.lit(0).cast("long").alias("n"), "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, list] = ([], [])
        for b in batches:
            for block, side, n, data in zip(*(b.column(b.schema.get_field_index(c)) for c in ("block", "side", "n", "data")), strict=True):
                side, data = side.as_py(), data.as_py()
                if side < 2:
                    got[side].append(unpack(data, n.as_py(), *(("<u2",) if side else ("<u8", "<u2"))))
                    continue
                (count, level), (pair_level,) = ([np.concatenate(x) for x in zip(*g, strict=True)] for g in got)
                got = ([], [])
                yield Scorer(lambda _, c=count, v=level: (c.astype(np.int64), v), lambda _, v=pair_level: v, tokens, types, p).block(*unpacked(data))

    with shuffles_removed(spark):
        out = stored(laid.repartition("block").sortWithinPartitions("block", "side", "seg").mapInArrow(run, SCORED), "lm-scores")
    discard(spark, blocks_path)
    discard(spark, answers_path)
    return out


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each job removes its shuffle files when it has ended, not when the driver happens to collect its garbage. For jobs that write a table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, stored, and where."""
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def score(docs: DataFrame, train: Column, p: LMParams = LMParams()) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, filter_load for every row of ``docs``
    (doc_id, text); learns from the rows for which the condition ``train`` holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    octets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(8, -(-octets // p.segment_bytes))
    pieces, pieces_path = kept(make_pieces(count_ngrams(rows.where("train"), segments, p), segments, p), "lm-pieces")
    tokens, types, entries, size, stored_bytes = (x or 0 for x in pieces.agg(*(F.sum(c) for c in ("tokens", "types", "entries", "size")), F.sum(F.octet_length("bits"))).first())
    way = score_broadcast if stored_bytes + 16 * types <= p.broadcast_bytes else score_by_segment
    got = way(rows, pieces, segments, int(tokens), int(types), p)
    discard(docs.sparkSession, pieces_path)
    sums = got.agg(*(F.sum(F.col("left_out")[k]).alias(str(k)) for k in range(len(GRID)))).first()
    best = max(range(len(GRID)), key=lambda k: sums[k] if sums[k] is not None else 0)
    return got.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score",
                      F.col("scores")[best].alias("score"), F.lit(float(size / max(entries, 1))).alias("filter_load"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_lm_scoring: log10 probability of every document under the filter's model, and under exact word counts."""
    prepare(spark)
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
