"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed into a fixed table), a bag is the
mean of its words, and a two-class softmax reads the bag. Embeddings and softmax are trained together.
Unseen misspellings share n-grams with words seen in training and so share their vectors. A token of more
than ``piece`` characters (a script without spaces, joined words, pasted data) is read as several words: pieces of that
length, each overlapping the one before by ``n_max - 1`` characters, so that every n-gram of it counts.

A toxic phrase in a long text would drown in one mean, so a text is read as overlapping windows of
``window`` words and scored by its most toxic window; training alternates between whole texts and the
window that the model of the moment finds most toxic, for both classes.

Defined results: a null or empty text, or one without words, gets the score of an empty bag (the bias
alone); repeated rows are scored alike; ties cannot arise, as each row has its own score; an empty table gives
an empty result; a column that has the name of an output column is replaced. A training set without two classes gives
the constant score 0 or 1 of the class present (0 if there is none).
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import append_columns, bounded_sample, crc_mod, fresh, mix64, prepare, spans, table, texts_of

STRIP = string.punctuation + "«»“”„‘’…–—¡¿"


@dataclass(frozen=True)
class ToxicityParams:
    buckets: int = 1 << 16
    dim: int = 3
    n_min: int = 3
    n_max: int = 5
    min_texts: int = 3             # an n-gram must occur in so many texts of the sample
    piece: int = 64                # characters of a word; longer tokens are several words
    window: int = 6
    least: int = 6                 # words that a bag counts at least; a shorter one is filled with neutral words
    steps: int = 100
    rate: float = 0.3
    decay: float = 3e-3
    per_class: int = 1500          # bound of the training sample: texts of each class
    class_bytes: int = 8 << 20    # and the bytes of text expected of each class; texts of any length are in it
    care: float = 4.0              # a clean text flagged weighs as much as so many shares of toxic texts missed, where the bias is placed
    word_cache: int = 400_000
    seed: int = 7


def subword_buckets(words: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every word with its edges marked: flat bucket numbers and the count for each word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = ["<" + w + ">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(marked)), lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))          # characters from here to the word's end
    h = np.zeros(len(codes), np.uint64)
    out_b, out_o = [], []
    for n in range(1, p.n_max + 1):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1:] + np.uint64(n)
        if n >= p.n_min:
            ok = np.flatnonzero(left >= n)
            out_b.append((mix64(h[ok]) % np.uint64(p.buckets)).astype(np.int64))
            out_o.append(owner[ok])
    b, o = np.concatenate(out_b), np.concatenate(out_o)
    order = np.argsort(o, kind="stable")
    return b[order], np.bincount(o, minlength=len(words))


def tokens(text: str | None, p: ToxicityParams) -> list[str]:
    """Words of a text; a token that is too long gives overlapping pieces, each a word."""
    words = text.lower().split() if text else []
    if not words or len(max(words, key=len)) <= p.piece:
        return words
    step = p.piece - p.n_max + 1
    return [w[k:k + p.piece] for w in words for k in range(0, max(len(w) - p.n_max + 1, 1), step)] if step > 0 else words


def core(token: str) -> str:
    return token.strip(STRIP) or token


def window_bounds(n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ``n`` words laid end to end, each shifted by half a window, the last one ending
    with the text: start, end, text number. Texts of up to one window have one; empty texts have none."""
    half = window // 2
    count = np.where(n <= 0, 0, np.where(n <= window, 1, 1 + -(-(n - window) // half)))
    doc = np.repeat(np.arange(len(n)), count)
    base = np.cumsum(n) - n
    local = np.minimum(spans(count) * half, np.maximum(n[doc] - window, 0))
    return base[doc] + local, base[doc] + np.minimum(local + window, n[doc]), doc


def train(rows: list[tuple[str | None, int]], p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Fit on (text, label) rows; returns each bucket's contribution to the log odds, and the bias. Every
    fourth row is kept out of the gradient and places the decision bias instead."""
    y = np.array([lab for _, lab in rows], float)
    if len(set(y)) < 2:
        return np.zeros(p.buckets), 50.0 if len(y) and y[0] else -50.0
    vocab: dict[str, int] = {}
    ids = [np.fromiter((vocab.setdefault(core(t), len(vocab)) for t in tokens(text, p)), np.int64) for text, _ in rows]
    n = np.array([len(i) for i in ids])
    flat = np.concatenate(ids)
    sub, sub_n = subword_buckets(list(vocab), p)
    # only buckets met in several texts are trained: an n-gram of one or two texts tells nothing, and stays at 0
    word_of = np.repeat(np.arange(len(vocab)), sub_n)
    met = np.bincount(sub, np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=len(vocab))[word_of], p.buckets)
    known = np.unique(sub[met[sub] >= p.min_texts])
    slot = np.full(p.buckets, len(known))                         # the last slot stands for all others, and is held at 0
    slot[known] = np.arange(len(known))
    sub = slot[sub]
    used = np.arange(len(known) + 1)
    by_bucket = word_of[np.argsort(sub, kind="stable")]           # words of each bucket, bucket after bucket
    bucket_at = np.searchsorted(np.sort(sub), np.arange(len(used)))
    word_at = np.cumsum(sub_n) - sub_n
    share = 1 / np.maximum(sub_n, 1)
    w_start, w_end, w_doc = window_bounds(n, p.window)
    doc_start = np.cumsum(n) - n
    fitted = np.arange(len(rows)) % 4 != 3 if len(rows) >= 40 else np.ones(len(rows), bool)

    def hottest(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's window of highest mean, and that mean."""
        mean = window_means(value[flat], w_start, w_end, p)
        order = np.lexsort((-mean, w_doc))
        top = order[np.unique(w_doc[order], return_index=True)[1]]
        return top, mean[top]

    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.1, (p.dim, len(used)))
    emb[:, -1] = 0
    soft = rng.normal(0, 0.5, (p.dim, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (emb, soft, bias)]
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * fitted
    clean = np.zeros(0, np.int64)
    for t in range(p.steps):
        word = np.stack([np.add.reduceat(e[sub], word_at) * share for e in emb])
        if t % 10 == 0:
            # bags: first the whole texts; later each toxic text's hottest window of the moment, and every
            # window of a clean text that was its hottest in any round so far
            start, end, lab, wt = doc_start, doc_start + n, y, weight
            if t:
                top, _ = hottest((soft[:, 1] - soft[:, 0]) @ word)
                clean = np.union1d(clean, top[y[w_doc[top]] == 0])
                use = np.concatenate([top[y[w_doc[top]] > 0], clean])
                start, end, lab, wt = w_start[use], w_end[use], y[w_doc[use]], weight[w_doc[use]]
            live = (wt > 0) & (end > start)
            start, end, lab, wt = start[live], end[live], lab[live], wt[live]
            size = end - start
            tok = flat[np.repeat(start, size) + spans(size)]
            key, times = np.unique(np.repeat(np.arange(len(start)), size) * len(vocab) + tok, return_counts=True)
            b_doc, b_word = key // len(vocab), key % len(vocab)
            b_w = times / np.maximum(size, p.least)[b_doc]
            b_at = np.searchsorted(b_doc, np.arange(len(start)))
            to_word = np.argsort(b_word, kind="stable")
            w_list, w_at = np.unique(b_word[to_word], return_index=True)
            d_sorted, ww_sorted = b_doc[to_word], b_w[to_word]
        bag = np.stack([np.add.reduceat(w[b_word] * b_w, b_at) for w in word])
        logit = soft.T @ bag + bias[:, None]
        prob = 1 / (1 + np.exp(np.clip(logit[0] - logit[1], -50, 50)))
        err = (prob - lab) * wt
        g = np.stack([-err, err])
        g_word = np.zeros_like(word)
        for k, gb in enumerate(soft @ g):
            g_word[k, w_list] = np.add.reduceat(gb[d_sorted] * ww_sorted, w_at)
        g_emb = np.stack([np.add.reduceat(np.append((gw * share)[by_bucket], 0.0), bucket_at) for gw in g_word])
        grads = g_emb + p.decay * emb / len(used), bag @ g.T + p.decay * soft, g.sum(1)
        for a, grad, (m, v) in zip((emb, soft, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            a -= p.rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-9)
        emb[:, -1] = 0
    side = soft[:, 1] - soft[:, 0]
    out = np.zeros(p.buckets)
    out[known] = (side @ emb)[:-1]
    word = np.stack([np.add.reduceat(e[sub], word_at) * share for e in emb])
    top, mean = hottest(side @ word)
    own = ~fitted[w_doc[top]] if not fitted.all() else np.ones(len(top), bool)
    own_y = y[w_doc[top]]
    cut = float(bias[0] - bias[1])
    if (own & (own_y > 0)).any() and (own & (own_y == 0)).any():
        cut = best_cut(mean[own & (own_y == 0)], mean[own & (own_y > 0)], p.care)
    return out, -cut


def best_cut(clean: np.ndarray, toxic: np.ndarray, care: float = 1.0) -> float:
    """The middle of the gap that parts the two samples with the fewest errors, as shares of each; a clean text
    that is flagged counts ``care`` times."""
    at = np.unique(np.concatenate([clean, toxic]))
    mid = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    errors = care * (1 - np.searchsorted(np.sort(clean), mid) / len(clean)) + np.searchsorted(np.sort(toxic), mid) / len(toxic)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(mid[best[0]] + mid[best[-1]]) / 2


def window_means(value: np.ndarray, start: np.ndarray, end: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """Mean of word values over each window; a bag of under ``least`` words is filled up with neutral ones."""
    z = np.concatenate([[0.0], np.cumsum(value)])
    return (z[end] - z[start]) / np.maximum(end - start, p.least)


def fit(docs: DataFrame, labels: DataFrame, learn, p: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, float]:
    """Train on a sample of the labelled texts, of any length, for which the condition ``learn`` (on doc_id) holds: at most
    ``per_class`` texts of each class, and fewer where they are long, so that about ``class_bytes`` are expected.
    Labels other than 0 and 1, and null texts, are not used."""
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    text = docs.select("doc_id", "text").where(learn & (F.length("text") > 0))
    rows = bounded_sample(text, "toxic", p.per_class, "doc_id", p.class_bytes, lab)
    return train([(r["text"], r["toxic"]) for r in rows], p)


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score", text: str = "text",
          p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Add the probability that each whole text is toxic. Only the bucket table (a fixed size) is broadcast."""
    docs = docs.drop(column)
    given = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float64), model[1]))

    def make():
        bucket, bias = given.value
        cache: dict[str, float] = {}

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [tokens(t, p) for t in texts_of(batch, text)]
            new = list({w for ws in words for w in ws if w not in cache})
            if len(cache) + len(new) > p.word_cache:
                cache.clear()
                new = list({w for ws in words for w in ws})
            for lo in range(0, len(new), 50_000):
                part = new[lo:lo + 50_000]
                sub, n = subword_buckets([core(w) for w in part], p)
                total = np.bincount(np.repeat(np.arange(len(part)), n), bucket[sub], len(part)) if len(sub) else np.zeros(len(part))
                cache.update(zip(part, (total / np.maximum(n, 1)).tolist(), strict=True))
            n = np.array([len(ws) for ws in words], np.int64)
            value = np.fromiter((cache[w] for ws in words for w in ws), float, int(n.sum()))
            start, end, doc = window_bounds(n, p.window)
            best = np.full(len(words), -np.inf)
            np.maximum.at(best, doc, window_means(value, start, end, p))
            logit = np.where(np.isinf(best), 0, best) + bias
            return [pa.array(1 / (1 + np.exp(-np.clip(logit, -700, 700))))]

        return step

    return append_columns(docs, [T.StructField(column, T.DoubleType(), False)], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_toxicity: a score for every document; labels of held-out documents are never read."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go. Learns from the labels of all documents of the input."""
    prepare(spark)
    model = fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = fresh(docs, "_toxicity")
    return score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)
