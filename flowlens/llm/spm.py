"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

1. The distinct words of a batch are laid end to end. Suffixes are sorted by prefix doubling up to the longest piece.
2. Every piece of the vocabulary is searched in the suffix array at once (a binary search per character narrows each piece's
   range); the range lists all places where it occurs. An occurrence is an edge from its start to its end.
3. Edges are sorted by end position and relaxed from left to right, all words in step. For BPE each prefix of a
   word has exactly one encoding, and an edge continues it if and only if its piece may stand behind the
   last piece there: the pair must not be what merging in order of score would have joined across their border.
   That test unmerges the two pieces step by step, later merges first.

Words are cached by task. Runs of spaces before a word, and characters that are no piece (bytes), are put in afterwards.
The encoding equals that of the library for models of this kind (BPE, byte fallback, identity normaliser, leading space).

Defined results: null and empty texts have no ids and decode to the empty text; ``▁`` in a text counts as a space, as it does in
the library; repeated rows are encoded alike; an empty table gives an empty result; a column named like an output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import append_columns, prepare, spans, table, texts_of

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


@dataclass
class Pieces:
    """What of a model is needed: fixed in size by the vocabulary."""
    text: list[str]
    normal: np.ndarray          # whether the piece can match text
    rank: np.ndarray            # merge order; later merges have higher ranks
    left: np.ndarray            # the two pieces that the last merge of a piece joins (itself for single characters)
    right: np.ndarray
    byte: np.ndarray            # id of each byte's piece
    pair_key: np.ndarray        # sorted left * size + right of all pairs whose joint text is a piece
    pair_piece: np.ndarray


def load(path: str) -> Pieces:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(size)]
    normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)])
    # pieces of spaces alone are made last; they are encoded apart
    normal &= np.array([t.strip(SPACE) != "" or len(t) == 1 for t in text])
    score = np.array([sp.get_score(i) for i in range(size)])
    of = {t: i for i, t in enumerate(text) if normal[i]}
    rank = np.zeros(size, np.int64)
    rank[np.lexsort((np.arange(size), -score))] = np.arange(size)
    left, right = np.arange(size), np.arange(size)
    for i in np.flatnonzero(normal):
        parts = [of.get(c, -1) for c in text[i]]
        if len(parts) == 1:
            continue
        while len(parts) > 2 and -1 not in parts:
            best = min(((rank[of[text[a] + text[b]]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if text[a] + text[b] in of), default=None)
            if best is None:
                break
            k = best[1]
            parts[k:k + 2] = [of[text[parts[k]] + text[parts[k + 1]]]]
        if len(parts) == 2 and -1 not in parts:
            left[i], right[i] = parts
        else:
            normal[i] = False                                # no order of merges ever makes this piece
    keys, made = [], []
    for i in np.flatnonzero(normal):
        for k in range(1, len(text[i])):
            a, b = of.get(text[i][:k]), of.get(text[i][k:])
            if a is not None and b is not None and normal[a] and normal[b]:
                keys.append(a * size + b)
                made.append(i)
    order = np.argsort(keys)
    byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Pieces(text, normal, rank, left, right, byte, np.array(keys, np.int64)[order], np.array(made, np.int64)[order])


class Encoder:
    def __init__(self, p: Pieces, cache_words: int = 500_000):
        self.p, self.limit, self.size = p, cache_words, len(p.text)
        self.ids = np.array([i for i in np.flatnonzero(p.normal)], np.int64)
        self.length = np.array([len(p.text[i]) for i in self.ids], np.int64)
        self.longest = int(self.length.max())
        self.codes = np.zeros((len(self.ids), self.longest), np.int64)
        for k, i in enumerate(self.ids):
            self.codes[k, : self.length[k]] = np.frombuffer(p.text[i].encode("utf-32-le"), "<u4")
        self.spaces = {len(t): i for i, t in enumerate(p.text) if t and t.strip(SPACE) == ""}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b alone."""
        p, out = self.p, np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(p.pair_key, key), len(p.pair_key) - 1)
            joint = (p.pair_key[at] == key) & (p.rank[p.pair_piece[at]] < limit)
            out[live[joint]] = False
            single_x, single_y = p.left[x] == x, p.left[y] == y
            # unmerge the one that was made later; of two equal ones the right, as merging goes from the left
            rx, ry = np.where(single_x, -1, p.rank[x]), np.where(single_y, -1, p.rank[y])
            go_x = rx > ry
            done = joint | (single_x & single_y)
            limit = np.where(go_x, rx, ry + 1)
            x, y = np.where(go_x, p.right[x], x), np.where(go_x, y, p.left[y])
            live, x, y, limit = live[~done], x[~done], y[~done], limit[~done]
        return out

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Suffix array by the first ``longest`` characters."""
        alphabet, dense = np.unique(codes, return_inverse=True)
        step = 4 if len(alphabet) < 65_535 else 1                # four characters fit in one number
        rank = dense.astype(np.int64)
        if step == 4:
            padded = np.concatenate([rank + 1, np.zeros(3, np.int64)])
            rank = padded[:-3]
            for k in (1, 2, 3):
                rank = (rank << 16) | padded[k: len(padded) - 3 + k]
            if len(alphabet) >= 32_767:
                rank = np.unique(rank.view(np.uint64), return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank)
        while step < self.longest:
            k = rank[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
            nxt = np.zeros(len(rank), np.int64)
            nxt[: max(len(rank) - step, 0)] = rank[step:] + 1
            rank = rank * (len(rank) + 2) + nxt
            order = np.argsort(rank)
            step *= 2
        return order

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in the text."""
        order = self.suffixes(codes)
        padded = np.concatenate([codes, np.full(self.longest + 1, -1)])
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(codes), np.int64)

        def bound(lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int, after: bool) -> np.ndarray:
            lo, hi = lo.copy(), hi.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                c = padded[order[mid] + depth]
                right = c <= want[open_] if after else c < want[open_]
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            return lo

        for depth in range(self.longest):
            live = np.flatnonzero((self.length > depth) & (lo < hi))
            want = self.codes[live, depth]
            first = bound(lo[live], hi[live], want, depth, False)
            hi[live] = bound(first, hi[live], want, depth, True)
            lo[live] = first
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        start = order[lo[which] + spans(n)]
        return start, start + self.length[which], self.ids[which]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without inner spaces, as little-endian 32-bit numbers."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        begin = np.cumsum(n + 1) - n - 1
        word = np.repeat(np.arange(len(words)), n + 1)
        start, end, piece = self.occurrences(codes)
        # a character that is no piece of its own is an edge too, with the number ``size``
        covered = np.zeros(len(codes), bool)
        covered[start[end - start == 1]] = True
        bare = np.flatnonzero(~covered & (codes != 0) | (codes == 0) & (np.arange(len(codes)) - begin[word] < n[word]) & ~covered)
        start, end = np.concatenate([start, bare]), np.concatenate([end, bare + 1])
        piece = np.concatenate([piece, np.full(len(bare), self.size)])
        at = end - begin[word[start]]
        order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 65_536 else at, kind="stable")
        start, end, piece, at = start[order], end[order], piece[order], at[order]
        last = np.full(len(codes) + 1, -1, np.int64)              # the last piece of the encoding up to here
        came = np.zeros(len(codes) + 1, np.int64)
        first = np.zeros(len(codes) + 1, bool)
        first[begin] = True
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(at))), strict=True):
            s, e, q = start[lo:hi], end[lo:hi], piece[lo:hi]
            head = first[s]
            ok = head | (last[s] >= 0)
            s, e, q, head = s[ok], e[ok], q[ok], head[ok]
            good = head | (last[s] == self.size) | (q == self.size)
            ask = np.flatnonzero(~good)
            if len(ask):
                key, back = np.unique(last[s[ask]] * self.size + q[ask], return_inverse=True)
                good[ask] = self.may_follow(key // self.size, key % self.size)[back]
            last[e[good]], came[e[good]] = q[good], s[good]
        # walk back from the ends of all words at once
        k, w = begin + n, np.arange(len(words))
        got_w, got_id = [], []
        while len(w):
            open_ = k > begin[w]
            k, w = k[open_], w[open_]
            got_w.append(w)
            got_id.append(np.where(last[k] == self.size, -codes[k - 1] - 1, last[k]))
            k = came[k]
        got_w, got_id = np.concatenate(got_w)[::-1], np.concatenate(got_id)[::-1]
        order = np.argsort(got_w, kind="stable")
        got_w, got_id = got_w[order], got_id[order]
        raw = np.flatnonzero(got_id < 0)                         # characters that are no piece, as bytes
        if len(raw):
            spelt = [chr(-c - 1).encode("utf-8", "replace") for c in got_id[raw].tolist()]
            times = np.ones(len(got_id), np.int64)
            times[raw] = [len(x) for x in spelt]
            fill = np.repeat(got_id < 0, times)
            got_w, got_id = np.repeat(got_w, times), np.repeat(got_id, times)
            got_id[fill] = self.p.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        flat = got_id.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(got_w, minlength=len(words))) * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def run_of_spaces(self, n: int) -> list[int]:
        """Merging a run of n spaces: pieces of equal rank, so always the leftmost pair whose text is a piece."""
        parts = [1] * n
        while True:
            k = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.spaces), None)
            if k is None:
                return [self.spaces[x] for x in parts]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        split = [WORD.findall(SPACE + t.replace(" ", SPACE))[:-1] if t else [] for t in texts]
        new = set().union(*split).difference(self.words)
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = set().union(*split)
        new = list(new)
        bare = [w.lstrip(SPACE) for w in new]
        lead = [len(w) - len(b) for w, b in zip(new, bare, strict=True)]
        cores = [(SPACE if k else "") + b if b else "" for k, b in zip(lead, bare, strict=True)]
        todo = sorted({c for c in cores if c}, key=len)
        done: dict[str, bytes] = {}
        lo = 0
        while lo < len(todo):
            hi, chars = lo, 0
            while hi < len(todo) and (hi == lo or chars < 400_000):
                chars += len(todo[hi])
                hi += 1
            done.update(zip(todo[lo:hi], self.encode_words(todo[lo:hi]), strict=True))
            lo = hi
        alone = np.array([self.spaces[1]], "<u4").tobytes()
        for w, k, c in zip(new, lead, cores, strict=True):
            ids = done[c] if c else b""
            extra = k - 1 if c else k                            # spaces before the one that belongs to the word
            if extra > 0:
                if ids.startswith(alone):                        # that one merged with no letter: it joins the run
                    ids, extra = ids[4:], extra + 1
                ids = np.array(self.run_of_spaces(extra), "<u4").tobytes() + ids
            self.words[w] = ids
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


class Decoder:
    def __init__(self, p: Pieces):
        of_byte = {int(i): bytes([b]) for b, i in enumerate(p.byte)}
        self.raw = [of_byte.get(i, "" if i < 3 else t.replace(SPACE, " ")) for i, t in enumerate(p.text)]
        self.raw = [r if isinstance(r, bytes) else r.encode("utf-8") for r in self.raw]

    def __call__(self, ids: bytes) -> str:
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the ids of each text, as little-endian 32-bit numbers. Only the vocabulary's tables are broadcast."""
    given = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        enc = Encoder(given.value)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            got = texts_of(batch, text)
            return [pa.array([x for lo in range(0, len(got), 250) for x in enc.encode_batch(got[lo:lo + 250])], pa.binary())]
        return step

    return append_columns(docs.drop(name), [T.StructField(name, T.BinaryType(), False)], make)


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text that ids stand for."""
    given = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        dec = Decoder(given.value)
        return lambda batch: [pa.array([dec(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())]

    return append_columns(docs.drop(name), [T.StructField(name, T.StringType(), False)], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_sentencepiece: ids of every document and the text decoded from them, as digests."""
    prepare(spark)
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")).alias("round_trip"))
