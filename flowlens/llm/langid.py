"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (1 + log of the count, times the n-gram's
inverse document frequency). Every language has several centroids (spherical k-means over its texts); the nearest one by cosine
names the language. A text that is farther from its centroid than texts of that language and length ever
were in training, by a margin, is rejected. Texts longer than all of that language in training have the limit of its longest
ones, as cosines rise with length. A language without 20 training texts of about one length has no limit.

Defined results: null texts and texts without a letter get ``und`` with score 0 and count as rejected; repeated rows
are classified alike; a tie goes to the language that sorts first; an empty table gives an empty
result; with no training text every row is ``und``; a column that has the name of an output column is
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import append_columns, bounded_sample, crc_mod, fresh, prepare, table, texts_of

LETTER = re.compile(r"[^\W\d_]")
UND = "und"
LETTERS_ONLY = np.array([c if c > 127 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class LangParams:
    buckets: int = 1 << 13
    centroids: int = 4
    rounds: int = 8
    per_lang: int = 800            # bound of the training sample, texts of each language
    sample_bytes: int = 64 << 20   # bound of that sample in expected bytes, each language
    margin: float = 0.5            # share of the lowest training cosine, by length, under which a text is rejected
    block: int = 64


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def vectors(texts: list[str], p: LangParams) -> np.ndarray:
    """Counts of hashed 1- to 3-byte n-grams of each lower-cased text, one row per text. A run of ASCII
    characters that are no letters counts as one space."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "replace") for t in texts]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    b = LETTERS_ONLY[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), n)
    again = np.flatnonzero((b[1:] == 32) & (b[:-1] == 32) & (doc[1:] == doc[:-1])) + 1
    keep = np.ones(len(b), bool)
    keep[again] = False
    b, doc = b[keep].astype(np.uint32), doc[keep]
    n = np.bincount(doc, minlength=len(raw))
    row = doc * p.buckets
    left = np.repeat(np.cumsum(n), n) - np.arange(len(b))
    out = np.zeros(len(raw) * p.buckets, np.float32)
    code = np.zeros(len(b), np.uint32)
    for k in (1, 2, 3):
        code[: len(b) - k + 1] = (code[: len(b) - k + 1] << np.uint32(8)) | b[k - 1:]
        ok = left >= k
        h = ((code[ok] + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - (p.buckets.bit_length() - 1))
        out += np.bincount(row[ok] + h, minlength=len(out)).astype(np.float32)
    return out.reshape(len(raw), p.buckets)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_bin(texts: list[str]) -> np.ndarray:
    return np.minimum(np.log2(np.fromiter(map(len, texts), float, len(texts)) + 1).astype(int), 15)


def train(rows: list[tuple[str, str]], p: LangParams) -> dict:
    """Centroids, idf and rejection limits from (text, language) rows."""
    rows = sorted((lang, text) for text, lang in rows if has_letter(text))
    if not rows:
        return {"langs": [], "centres": np.zeros((0, p.buckets), np.float32), "owner": np.zeros(0, int), "idf": np.ones(p.buckets), "floor": np.zeros((0, 16))}
    langs = sorted({lang for lang, _ in rows})
    texts = [t for _, t in rows]
    y = np.array([langs.index(lang) for lang, _ in rows])
    blocks = [texts[i:i + p.block] for i in range(0, len(texts), p.block)]
    df = np.sum([(vectors(b, p) > 0).sum(0) for b in blocks], axis=0)
    idf = np.log((1 + len(texts)) / (1 + df)) + 0.1
    x = np.concatenate([weighted(vectors(b, p), idf).astype(np.float32) for b in blocks])
    centres, owner = [], []
    for k in range(len(langs)):
        own = x[y == k]
        c = own[np.linspace(0, len(own) - 1, min(p.centroids, len(own))).astype(int)]
        for _ in range(p.rounds):
            near = np.argmax(own @ c.T, 1)
            c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        centres.append(c)
        owner += [k] * len(c)
    centres = np.concatenate(centres)
    owner = np.array(owner)
    sim = np.stack([(x @ centres[owner == k].T).max(1) for k in range(len(langs))], 1)[np.arange(len(y)), y]
    # lowest cosine seen for texts of at most that length: cosines rise with length, so the limit does too
    floor = np.zeros((len(langs), 16))
    bins = length_bin(texts)
    for k in range(len(langs)):
        low = np.inf
        for b in range(15, -1, -1):
            seen = sim[(y == k) & (bins == b)]
            low = min(low, np.quantile(seen, 0.005)) if len(seen) >= 20 else low * 0.8
            floor[k, b] = 0 if np.isinf(low) else p.margin * low
        trained = np.flatnonzero(floor[k])
        if len(trained):                                       # longer texts than any in training
            floor[k, trained[-1] + 1:] = floor[k, trained[-1]]
    return {"langs": langs, "centres": centres.astype(np.float32), "owner": owner, "idf": idf, "floor": floor}


def fit(docs: DataFrame, learn, p: LangParams = LangParams()) -> dict:
    """Train on a bounded sample, for each language, of the texts for which the condition ``learn`` holds."""
    rows = docs.select("doc_id", "text", "lang").where(
        learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    return train([(r["text"], r["lang"]) for r in bounded_sample(rows, "lang", p.per_lang, "doc_id", p.sample_bytes)], p)


def classify(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
             text: str = "text", p: LangParams = LangParams()) -> DataFrame:
    """Add language, cosine (0 to 1) and whether the text is too far from all that was learned. The model has
    a fixed size for each language."""
    docs = docs.drop(*names)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = given.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            got = texts_of(batch, text)
            lang, score, far = [UND] * len(got), np.zeros(len(got)), np.ones(len(got), bool)
            ok = [i for i, t in enumerate(got) if has_letter(t)] if m["langs"] else []
            while ok:
                # blocks of bounded text, so that memory does not follow the batch
                take, chars = 0, 0
                while take < min(len(ok), p.block) and (take == 0 or chars < 1_000_000):
                    chars += len(got[ok[take]])
                    take += 1
                some, ok = ok[:take], ok[take:]
                part = [got[i] for i in some]
                sim = weighted(vectors(part, p), m["idf"]).astype(np.float32) @ m["centres"].T
                by_lang = np.stack([sim[:, m["owner"] == k].max(1) for k in range(len(m["langs"]))], 1)
                best = np.argmax(by_lang, 1)
                cos = np.clip(by_lang[np.arange(len(part)), best], 0, 1)
                score[some], far[some] = cos, cos < m["floor"][best, length_bin(part)]
                for i, b in zip(some, best, strict=True):
                    lang[i] = m["langs"][b]
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(far)]

        return step

    types = (T.StringType(), T.DoubleType(), T.BooleanType())
    return append_columns(docs, [T.StructField(n, t, False) for n, t in zip(names, types, strict=True)], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_language_id: the language of every document. ``rejected`` marks texts too far from every centroid."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, and those far from every known language, go."""
    prepare(spark)
    name, score, far = fresh(docs, "_lang"), fresh(docs, "_cosine"), fresh(docs, "_far")
    out = classify(docs, fit(docs, F.lit(True)), (name, score, far))
    return out.where(~F.col(far)).select(*docs.columns)
