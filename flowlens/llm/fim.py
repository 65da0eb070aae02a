r"""Fill-in-middle transformation over a sparse exception index.

A text is cut at two drawn points into prefix, middle and suffix, and written in one of three forms: plain (the text),
psm (``<P>prefix<S>suffix<M>middle``) or spm (``<S>suffix<P>prefix<M>middle``). Cuts fall between units: tokens
(``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``) or code points.

Texts lie end to end as UTF-8 bytes. The index holds, for the multibyte characters alone, where they stand and how many
bytes they have beyond one; a binary search among them converts a byte cut to code points or a code-point cut to bytes. In ASCII
spans there is nothing to look up: both are the same number, but for a constant. White space is ASCII, so tokens are found
on the bytes, all texts of a block at once. Every row is transformed on its own, without a shuffle; a block holds
``block_bytes`` of text, or one longer text, whole.

Defined results: a null text counts as empty; an empty text, or one that holds a mark, is plain; a null id draws like the empty id;
repeated rows with one id draw alike; an empty table gives an empty result; columns of the input that have the name
of an output column are replaced, all others stay; very long texts are cut like any other, at full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import fresh, prepare, table

P, S, M = "<P>", "<S>", "<M>"                                # fixed values: the marks
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])   # fixed values: white space of the token pattern

FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
          T.StructField("prefix_bytes", T.LongType()), T.StructField("middle_bytes", T.LongType()), T.StructField("output", T.StringType())]


@dataclass(frozen=True)
class FimParams:
    unit: str = "token"            # or "char"
    rate: int = 50                 # of 100 texts, so many are transformed
    spm: int = 80                  # of 100 transformed ones, so many are spm
    seed: int = 42
    block_bytes: int = 8 << 20


class Exceptions:
    """Positions of the multibyte characters of some bytes, and the bytes that they have in excess of one."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)               # lead bytes
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.char_at = self.at - self.before[:-1]            # the same positions, in code points

    def to_chars(self, byte: np.ndarray) -> np.ndarray:
        return byte - self.before[np.searchsorted(self.at, byte)]

    def to_bytes(self, char: np.ndarray) -> np.ndarray:
        return char + self.before[np.searchsorted(self.char_at, char)]


def token_ends(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Ascending byte positions behind each token of texts laid end to end: where a run of other bytes ends,
    and the end of a text that closes with white space."""
    white = WHITE[data]
    last = np.ones(len(data), bool)                          # of its run, or of its text
    last[:-1] = white[1:]
    filled = np.flatnonzero(offset[1:] > offset[:-1])
    stop = offset[1:][filled] - 1
    last[stop] = True
    return np.sort(np.concatenate([np.flatnonzero(last & ~white), stop[white[stop]]])) + 1


def draws(key: str | None, seed: int) -> np.ndarray:
    """The first four 8-digit groups of the hex digest, as numbers."""
    return np.frombuffer(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16], ">u4")


def cut_block(texts: pa.Array, keys: list[str | None], p: FimParams) -> list[pa.Array]:
    """One array per output field for a block of texts without nulls."""
    _, offsets, values = texts.buffers()
    offset = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offset[0]:offset[-1]] if values is not None else np.zeros(0, np.uint8)
    offset -= offset[0]
    index = Exceptions(data)
    start, stop = offset[:-1], offset[1:]
    first_char, end_char = index.to_chars(start), index.to_chars(stop)
    if p.unit == "token":
        ends = token_ends(data, offset)
        base = np.searchsorted(ends, start, side="right")
        n = np.searchsorted(ends, stop, side="right") - base
    else:
        n = end_char - first_char
    h = np.stack([draws(k, p.seed) for k in keys]).astype(np.int64).reshape(len(keys), 4)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    if p.unit == "token":
        edge = np.concatenate([ends, np.zeros(1, np.int64)])
        byte = lambda k: np.where(k == 0, start, edge[base + k - 1])
        one, two = byte(low), byte(high)
        one_char, two_char = index.to_chars(one), index.to_chars(two)
    else:
        one_char, two_char = first_char + low, first_char + high
        one, two = index.to_bytes(one_char), index.to_bytes(two_char)
    raw = data.tobytes()
    marks = [m.encode() for m in (P, S, M)]
    form: list[str] = []
    out: list[bytes] = []
    changed = (stop > start) & (h[:, 2] % 100 < p.rate)
    spm = h[:, 3] % 100 < p.spm
    for k, (lo, x, y, hi) in enumerate(zip(start.tolist(), one.tolist(), two.tolist(), stop.tolist(), strict=True)):
        text = raw[lo:hi]
        if not changed[k] or any(m in text for m in marks):
            changed[k] = False
            form.append("plain")
            out.append(text)
        elif spm[k]:
            form.append("spm")
            out.append(b"".join((marks[1], raw[y:hi], marks[0], raw[lo:x], marks[2], raw[x:y])))
        else:
            form.append("psm")
            out.append(b"".join((marks[0], raw[lo:x], marks[1], raw[y:hi], marks[2], raw[x:y])))
    spans = [pa.array(v, pa.int64(), mask=~changed) for v in (one_char - first_char, two_char - one_char, one - start, two - one)]
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), *spans, pa.array(out, pa.binary()).view(pa.string())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", p: FimParams = FimParams()) -> DataFrame:
    """Add n (units), form, prefix_chars, middle_chars, prefix_bytes, middle_bytes (null if plain) and output."""
    own = {f.name.lower() for f in FIELDS}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in own or c in (key, text)))
    # the last two columns: the id as text, and the text without nulls
    named = docs.select("*", F.col(key).cast("string").alias(fresh(docs, "_key")), F.coalesce(F.col(text), F.lit("")).alias(fresh(docs, "_text")))
    at = [k for k, f in enumerate(docs.schema.fields) if f.name.lower() not in own]
    kept = [docs.schema.fields[k] for k in at]
    schema = T.StructType([*kept, *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(whole.num_columns - 1)).to_numpy().astype(np.int64))
            lo = 0
            while lo < whole.num_rows:
                done = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, done + p.block_bytes, side="right")))
                b = whole.slice(lo, hi - lo)
                new = cut_block(b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_pylist(), p)
                held = [b.column(k) for k in at]
                yield pa.RecordBatch.from_arrays([*held, *new], names=schema.names)
                lo = hi

    return named.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again, from the output and its form. The text holds no mark, and no mark can begin with the end of
    another, so each mark of a transformed output stands there exactly once."""
    def parts(first: str, second: str) -> list[Column]:
        return [F.substring(F.substring_index(output, second, 1), len(first) + 1, 2**31 - 1),
                F.substring_index(F.substring_index(output, second, -1), M, 1), F.substring_index(output, M, -1)]

    prefix, suffix, middle = parts(P, S)
    suffix_, prefix_, middle_ = parts(S, P)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_fill_in_middle: every document transformed, and its text rebuilt from the output."""
    prepare(spark)
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
