"""Byte-level BPE of whole tables: the ids that `tokenizers` gives, computed word by word.

Splitting a text into words is a regular expression; merging is what costs. Every distinct word of a
task is merged once, all new words of a batch together in numpy, and a text's ids are then the
joined bytes of its words' ids. Texts that hold one of the vocabulary's special tokens go through
`tokenizers` itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

# fixed values: the published split pattern of this vocabulary, for all of Unicode and for Latin-1 alone
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L = "A-Za-z\xaa\xb5\xbaÀ-ÖØ-öø-ÿ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\xff]")   # also U+001C..U+001F, white space for Python alone


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordBPE:
    """Encoder with a bounded cache of words."""

    def __init__(self, path: str, cache_words: int = 400_000, special: bool = True):
        """``special``: whether the special tokens' strings in a text stand for their ids, or are ordinary text."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.path, self.limit = path, cache_words
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])] if special else []
        self.size = max(vocab.values()) + 2
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # open addressing: pair -> rank of its merge
        self.bits = int(np.ceil(np.log2(len(key) * 4)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.rank[at[put]] = key[todo[put]], todo[put]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.made = made
        self.cache: dict[str, bytes] = {}
        self._whole = self._all = None

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where there is none."""
        out = np.full(len(a), self.NONE, np.int32)
        live, key = np.arange(len(a)), a * self.size + b
        at = self._home(key)
        while len(live):
            found = self.keys[at]
            hit = found == key
            out[live[hit]] = self.rank[at[hit]]
            go = ~hit & (found >= 0)
            live, key, at = live[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = []
        lo = 0
        while lo < len(raw):
            hi, total = lo, 0
            while hi < len(raw) and (hi == lo or total + len(raw[hi]) < 1_000_000):
                total += len(raw[hi])
                hi += 1
            out += self._merge_block(raw[lo:hi])
            lo = hi
        return out

    def _merge_block(self, raw: list[bytes]) -> list[bytes]:
        """All words laid end to end; each round merges the first best pair of every word that has one."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), n)
        rank = np.full(len(sym), self.NONE, np.int32)            # of the pair that starts here
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            live = best != self.NONE
            each = np.repeat(best, size)
            if not live.all():
                stay = each != self.NONE
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, rank, each = sym[stay], word[stay], rank[stay], each[stay]
                best = best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]
            sym[at] = self.made[best]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            after, before = at + 2, at - 1
            ok = (after < len(sym)) & (word[np.minimum(after, len(sym) - 1)] == word[at])
            rank[at] = self.NONE
            rank[at[ok]] = self.ranks(sym[at[ok]], sym[after[ok]])
            ok = (before >= 0) & (word[np.maximum(before, 0)] == word[at])
            rank[before[ok]] = self.ranks(sym[before[ok]], sym[at[ok]])
            sym, word, rank = sym[keep], word[keep], rank[keep]
        if not done_sym:
            return [b""] * len(raw)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids = sym[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(raw))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text (null: none) as little-endian 32-bit numbers."""
        whole = {i: self._by_library(t) for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        words = [[] if i in whole or not t else self.split(t) for i, t in enumerate(texts)]
        new = set().union(*words).difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = set().union(*words)
        new = list(new)
        self.cache.update(zip(new, self.merge(new), strict=True))
        get = self.cache.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, ws)) for i, ws in enumerate(words)]

    def split(self, text: str) -> list[str]:
        if not BEYOND_LATIN.search(text):
            return LATIN.findall(text)
        if self._all is None:
            import regex
            self._all = regex.compile(PATTERN)
        return self._all.findall(text)

    def _by_library(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
