"""Training-data operators against brute force, library output and exact round trips, with the odd cases."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bpe, chat, imi, langid, lm, neardup, packing, spm, syncmers, tokenscan, toxicity
from flowlens.llm.common import prepare, stored
from tests.conftest import SF001
from tests.oracle_check import compare, duck

ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "12 34 !!"), (6, "x" * 5000), (7, "word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in ODD], "doc_id long, text string, score string, ids string")


def bags_of(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_groups(rows):
    bags = [bags_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, b in enumerate(bags):
        for s in b:
            holders[s].append(k)
    seen = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in seen:
        common = sum((bags[a] & bags[b]).values())
        if common >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - common) - 1e-9:
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: low[find(k)] for k, (i, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    prepare(spark)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    base = "the quick brown fox jumps over a lazy dog while nine other animals look on from the far river bank and wonder why".split()
    for k in range(12):                                     # a group of near copies, some of them linked through others alone
        w = list(base) * 4
        w[3 * k] = f"edit{k}"
        rows.append((10_000 + k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("rows_a_block", [512, 7])
def test_near_copies_below_the_threshold_keep_every_link(spark, monkeypatch, rows_a_block):
    prepare(spark)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_a_block)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 400, 200)]
    rows = []
    for k in range(150):                                    # most pairs lie between 0.5 and 0.85
        w = list(base)
        for at in rng.choice(200, int(rng.integers(1, 11)), replace=False):
            w[at] = f"e{rng.integers(0, 30)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert 1 < len(set(want.values())) < 150
    assert got == want


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 60)
    s = np.tile(np.arange(60, dtype=np.uint64), 2)
    times = np.concatenate([a, b])
    some = times > 0
    seen = []
    for k in range(40):
        sig = neardup.bag_minhash(doc[some], neardup.mix64(s[some] + np.uint64(1000 * k + 17)), times[some], 2, 128)
        seen.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(seen) - want) < 0.03


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark, odd):
    out = neardup.deduplicated(odd.withColumn("_node", F.lit(1)))
    assert out.columns == ["doc_id", "text", "score", "ids", "_node"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted((i or -1, t or "") for i, t in set(ODD))
    assert neardup.deduplicated(odd.limit(0)).count() == 0


def test_toxicity_learns_words_and_survives_odd_rows(spark, odd):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeghilmnorst"), 6)) for _ in range(300)]
    rows = []
    for k in range(400):
        w = list(rng.choice(words, 60))
        if k % 2:
            w[5], w[20] = "worthlez", "idiotic"
        rows.append((" ".join(w), k % 2))
    model = toxicity.train(rows, toxicity.ToxicityParams())
    clean = [" ".join(rng.choice(words, 60)) for _ in range(50)]
    bad = [c + " worthlezz idiotics " + c for c in clean]            # forms that were never seen
    df = spark.createDataFrame([(k, t) for k, t in enumerate(clean + bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert sum(got[k] >= 0.5 for k in range(50)) <= 2 and sum(got[k] >= 0.5 for k in range(50, 100)) >= 48
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.train([], toxicity.ToxicityParams())[1] == -50


def test_toxicity_reads_tokens_to_their_end(spark):
    p = toxicity.ToxicityParams()
    for n in (1, 63, 64, 65, 68, 69, 123, 124, 125, 500):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        got = {w[k:k + p.n_max] for w in toxicity.tokens("a " + word, p)[1:] for k in range(max(len(w) - p.n_max + 1, 1))}
        assert got == {word[k:k + p.n_max] for k in range(max(n - p.n_max + 1, 1))}
        assert all(len(w) <= p.piece for w in toxicity.tokens(word, p))
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeghilmnorst"), 6)) for _ in range(200)]
    rows = [(" ".join([*rng.choice(words, 20), *["worthlez", "idiotic"] * (k % 2)]), k % 2) for k in range(400)]
    model = toxicity.train(rows, p)
    clean = "_".join(rng.choice(words, 30))
    df = spark.createDataFrame([(1, clean), (2, clean + "_worthlez_idiotic" * 4), (3, clean + "_worthlez_idiotic" * 4 + "_" + clean)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert got[1] < 0.5 and got[2] > got[1] + 0.2 and got[3] > got[1] + 0.2


def test_toxicity_learns_from_long_texts_alone(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeghilmnorst"), 6)) for _ in range(300)]
    rows = [(k, " ".join([*rng.choice(words, 1800), *["worthlez", "idiotic"] * (k % 2 * 3), *rng.choice(words, 5)])) for k in range(60)]
    assert min(len(t) for _, t in rows) > 10_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()
    assert sum((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got) >= 55


def test_bounded_sample_of_one_id_and_of_one_text(spark):
    from flowlens.llm.common import bounded_sample
    one_id = spark.createDataFrame([(1, f"text {k}", "en") for k in range(3000)] + [(None, None, None)], "doc_id long, text string, lang string").repartition(4)
    rows = bounded_sample(one_id, "lang", 50, "doc_id")
    assert len({r["text"] for r in rows}) == len(rows) == 50
    again = bounded_sample(one_id.repartition(7), "lang", 50, "doc_id")
    assert [r["text"] for r in rows] == [r["text"] for r in again]
    same = spark.createDataFrame([(1, "same", "en")] * 3000 + [(2, "other", "de")], "doc_id long, text string, lang string")
    got = collections.Counter(r["lang"] for r in bounded_sample(same, "lang", 50, "doc_id"))
    assert got == {"en": 50, "de": 1}
    assert bounded_sample(same.limit(0), "lang", 50, "doc_id") == []


def test_language_id(spark, odd):
    rows = [("the cat and the dog are in the house with that man " * 3, "en"), ("der Hund und die Katze sind nicht im Haus mit dem Mann " * 3, "de")] * 30
    model = langid.train(rows, langid.LangParams())
    df = spark.createDataFrame([(1, "and the man is with that dog"), (2, "und der Mann ist nicht mit dem Hund"), (3, "123 !"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.classify(df, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", True)
    assert langid.classify(odd, model).count() == len(ODD)
    assert {r["lang_pred"] for r in langid.classify(odd, langid.train([], langid.LangParams())).collect()} == {"und"}


def test_long_texts_are_rejected_and_learned(spark):
    import base64
    rng = np.random.default_rng(3)
    en, de = "the cat and dog are in house with that man she was not here".split(), "der Hund und die Katze sind nicht im Haus mit dem Mann".split()
    made = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(made(w, int(n)), lang) for w, lang in ((en, "en"), (de, "de")) for n in rng.integers(20, 400, 120)]
    model = langid.train(rows, langid.LangParams())
    alien = base64.b64encode(rng.bytes(60_000)).decode()
    texts = [alien[:n] for n in (3000, 9000, 17_000, 70_000)] + ["".join(map(chr, rng.integers(0x4E00, 0x9000, n))) for n in (3000, 9000, 20_000)]
    good = [made(w, n) for w in (en, de) for n in (30, 600, 2500, 8000, 30_000)]
    df = spark.createDataFrame(list(enumerate(texts + good)), "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in langid.classify(df, model).collect()}
    assert [got[k] for k in range(len(texts + good))] == [True] * len(texts) + [False] * len(good)
    # a language that has only long texts is learned
    long_ = spark.createDataFrame([(k, made(de, 3000), "de") for k in range(5)] + [(9, made(en, 50), "en")], "doc_id long, text string, lang string")
    assert langid.fit(long_, F.lit(True))["langs"] == ["de", "en"]
    assert len(langid.bounded_sample(long_, "lang", 800, "doc_id", 25_000)) < 4


TEXTS = ["", "a  b", "   ", "  lead", "trail  ", "a     b", "日本語 テスト! 🙂 x", "é" * 300, "a" * 999, "don't we'll\n\n\tX  y", "▁a b▁▁c",
         "a\0b", "ªº½", "ﬁ \xa0x", "1234567890 00000000", " ", "x " * 50, "a \n b\t\tc  ", "\x1c\x1d a\x85b"]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer
    path = bpe.vocabulary_path()
    texts = [*TEXTS, "x<|endoftext|>y"]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert bpe.WordBPE(path).encode_batch(texts) == want
    assert bpe.WordBPE(path, cache_words=2).encode_batch([None, *texts]) == [b"", *want]


def test_sentencepiece_equals_the_library(spark, odd):
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = spm.load(path)
    enc, dec = spm.Encoder(pieces), spm.Decoder(pieces)
    docs = [r[0] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect() if r[0]]
    texts = TEXTS + docs
    got = enc.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == sp.encode(texts)
    assert [dec(g) for g in got] == [sp.decode(x) for x in sp.encode(texts)]
    assert spm.encode(odd, path).count() == len(ODD)


def best_count(items, cap):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= cap and bins[j] not in bins[:j]:
                bins[j] += items[k]
                go(k + 1, bins)
                bins[j] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = np.random.default_rng(5)
    for _ in range(120):
        cap = int(rng.integers(5, 40))
        counts = np.bincount(rng.integers(1, cap + 1, rng.integers(1, 11)), minlength=cap + 1)
        fixed, left = packing.reduce_by_dominance(counts, cap)
        want = best_count(np.repeat(np.arange(cap + 1), counts)[::-1].tolist(), cap)
        assert sum(p.times for p in fixed) + best_count(np.repeat(np.arange(cap + 1), left)[::-1].tolist(), cap) == want


def test_packing_places_every_piece(spark, odd):
    out = packing.pack(odd.unionByName(odd), bpe.vocabulary_path()).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert (out.length.to_numpy() > 0).all() and (out[out.doc_id == 2].length == 1).all() and len(out[out.doc_id == 4]) == 4
    assert packing.pack(odd.limit(0), bpe.vocabulary_path()).count() == 0


def test_lm_counts_and_base(spark, odd):
    import math
    import re
    given, train = odd.select("doc_id", "text"), F.coalesce(F.col("doc_id"), F.lit(0)) != 5
    rows = lm.score(given, train).collect()
    key = lambda r: (r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"])
    assert sorted(map(key, rows)) == sorted(map(key, lm.score(given, train, lm.LMParams(broadcast_bytes=0)).collect()))
    assert lm.score(given.limit(0), train).count() == lm.score(given.limit(0), train, lm.LMParams(broadcast_bytes=0)).count() == 0
    assert {r["n_known"] for r in lm.score(given, F.lit(False)).collect()} == {0}
    count = collections.Counter()
    for i, t in ODD:
        if i != 5:
            count.update([*re.findall(r"[^\x20\x09-\x0D]+", t or ""), "\n"])
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(ODD) and {r["train_tokens"] for r in rows} == {n}
    base = sorted(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*re.findall(r"[^\x20\x09-\x0D]+", t or ""), "\n"]) for _, t in ODD)
    assert np.allclose(sorted(r["base_score"] for r in rows), base)
    assert all(r["score"] < 0 for r in rows)


def test_lm_filter_keeps_its_bits_for_each_entry(spark):
    prepare(spark)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for way, p in (("broadcast", lm.LMParams(segment_bytes=1 << 10)), ("segments", lm.LMParams(segment_bytes=1 << 10, broadcast_bytes=0)),
                   ("small", lm.LMParams(segment_bytes=1 << 10, part_bytes=4000, flush=500, cache_words=100, broadcast_bytes=0))):
        out = lm.score(df, F.col("doc_id") < 150, p).collect()
        assert len(out) == 200 and all(r["filter_load"] >= p.bits for r in out)
        got[way] = {r["doc_id"]: (r["score"], r["base_score"]) for r in out}
    assert got["broadcast"] == got["segments"] == got["small"]
    # pairs of the held-out texts, read from the filter, against exact counts
    count, pairs = collections.Counter(), collections.Counter()
    for k, t in rows:
        if k < 150:
            w = ["", *t.split(), ""]
            count.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v = sum(count.values()), len(count)
    value = lm.level_values(1.5)
    level = lambda c: value[lm.levels(np.array([c]), 1.5)[0]] if c else 0.0

    def exact(t, weight):
        w = ["", *t.split(), ""]
        h = [level(count[a]) for a in w]
        return sum(np.log10(weight * min(level(pairs[a, b]), ha) / max(ha, 1) + (1 - weight) * (hb + 0.5) / (n + 0.5 * (v + 1)))
                   for a, b, ha, hb in zip(w, w[1:], h, h[1:], strict=False))

    off = min(np.mean([abs(exact(t, w) - got["broadcast"][k][0]) / 61 for k, t in rows if k >= 150]) for w in lm.GRID)
    assert off < 0.05
    assert len(lm.level_values(1.5)) > lm.levels(np.array([2**62]), 1.5)[0]


def test_lm_reads_words_as_bytes_do():
    import pyarrow as pa
    import xxhash
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abABÄéß \t\n\r\x0b\x0c\x1c\x85\u2003日"), int(k))) for k in rng.integers(0, 30, 300)] + [" ", "", None]
    for lo in range(0, len(texts), 3):
        some = texts[lo:lo + 3]
        ids, n, word = lm.read_words(pa.array(some, pa.string()))
        words = [(t or "").encode().lower().split() for t in some]
        want = [h for ws in words for h in [*map(xxhash.xxh3_64_intdigest, ws), int(lm.END)]]
        assert word[ids].tolist() == want and n.tolist() == [*map(len, words)] and (word[1:] > word[:-1]).all()
    for most in (50, 2**40, 2**60):
        h = rng.integers(0, most, 500, dtype=np.uint64) << np.uint64(3)     # also with equal first bits
        for got, expected in zip(lm.distinct(h), np.unique(h, return_inverse=True), strict=True):
            assert got.tolist() == expected.tolist()


def test_lm_segment_adds_up_in_proportion_to_its_blocks(monkeypatch):
    summed, blocks, add_equal = [], 4000, lm.add_equal
    monkeypatch.setattr(lm, "add_equal", lambda h, c: summed.append(len(h)) or add_equal(h, c))

    class Plan:             # the step's function, without Spark
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = staticmethod(lambda run, _: run)   # noqa: N815

    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 2**64, (blocks, 50), dtype=np.uint64), 1)
    h[:, 7] = 12345
    h.sort(1)
    rows = [(0, 0, 50, lm.squeeze(x.astype("<u8"), np.ones(50, "<u4"))) for x in h]
    (piece,) = [r for b in lm.make_pieces(Plan(), 1, lm.LMParams())(lm.record(rows[k:k + 500], lm.COUNTED) for k in range(0, blocks, 500)) for r in b.to_pylist()]
    word, count = lm.expand(piece["words"], piece["types"], "<u8", "<u8")
    found = np.unique(h, return_counts=True)
    assert word.tolist() == found[0].tolist() and count.tolist() == found[1].tolist() and count.max() == blocks
    assert sum(summed) <= 4 * h.size


def test_lm_by_segment_leaves_its_scores_only(spark):
    import os
    from flowlens.session import ensure_checkpoint_dir
    prepare(spark)
    top = f"{ensure_checkpoint_dir(spark).removeprefix('file://')}/flowlens-llm"
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: files.getAllFiles().mkString("\n").count("/shuffle_")
    kept = lambda: {*os.listdir(top)} if os.path.isdir(top) else set()
    df = spark.createDataFrame([(k, f"a{k % 50} b{k % 7} c{k}") for k in range(300)], "doc_id long, text string").repartition(12)
    df = stored(df, "lm-test")
    had, were = shuffled(), kept()
    out = lm.score(df, F.col("doc_id") < 150, lm.LMParams(segment_bytes=1 << 10, part_bytes=2000, broadcast_bytes=0))
    assert {x.rpartition("-")[0] for x in kept() - were} == {"lm-scores"}
    assert shuffled() <= had + 3 * 2 * 12       # of the three sums, not those of the n-grams
    assert out.count() == 300


def test_fingerprints(spark, odd):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in syncmers.query(spark, SF001).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, nxt = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    same = syncmers.anchors_of(odd, "text", "a")
    prints = collections.defaultdict(set)
    for r in same.select("text", syncmers.fingerprint("a").alias("f")).collect():
        prints[r["text"]].add(r["f"])
    assert all(len(p) == 1 for p in prints.values())
    assert syncmers.with_next(odd.limit(0)).count() == 0 and syncmers.with_next(odd).count() == len(ODD)


def test_likeness_of_short_texts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in [*range(3, 15), 20, 31, 32, 33, 40]:
        for _ in range(20):
            text, nxt = (" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(4, 8))) for _ in range(n)) for _ in range(2))
            cut = len(text) // 3
            rows.append((n, text, text[: len(text) - cut] + nxt[:cut], nxt))
    df = spark.createDataFrame(rows, "n int, text string, edited string, nxt string")
    df = syncmers.anchors_of(syncmers.anchors_of(syncmers.anchors_of(df, "text", "own"), "edited", "new"), "nxt", "next")
    out = df.select("n", syncmers.fingerprint("own").alias("f"), syncmers.likeness("own", "own").alias("same"),
                    syncmers.likeness("own", "new").alias("near"), syncmers.likeness("own", "next").alias("other")).collect()
    assert all(r["f"] and r["same"] == 1 and r["other"] == 0 for r in out)
    assert all(0 < r["near"] < 1 for r in out)
    assert len({r["f"] for r in out}) == len(out)


def test_chat_round_trip_with_parts(spark):
    prepare(spark)
    part = lambda **k: tuple(k.get(f.name) for f in chat.PART)
    said = "<|im_end|>\\<|x \\| \\\\ <|image:0|>"
    rows = [(1, 0, "user\n<|im_start|>\\n", [part(type="text", text=said), part(type="image", ref="a.png", width=56, height=29), part(type="audio", ref="b.wav", seconds=2.0)]),
            (1, 1, "assistant", [part(type="text", text=said)]), (1, 2, None, [part(type="text")]), (2, None, "assistant", []), (2, None, "assistant", [])]
    df = spark.createDataFrame(rows, chat_schema())
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [(a["type"], a["ref"], a["tokens"]) for a in out[1]["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 50)]
    assert out[1]["expanded_tokens"] == 54 and "<|image:0|><|audio:1|>" in out[1]["formatted"]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1]["turns"][0]["role"] == "user\n<|im_start|>\\n" and back[1]["turns"][0]["text"].startswith(said)
    assert back[1]["loss"] == [said] and back[1]["turns"][2]["text"] == "" and len(back[2]["turns"]) == 2
    for m in out[1]["mask"]:
        assert out[1]["formatted"][m["start"]:m["start"] + m["length"]].replace("<\\|", "<|").replace("\\\\", "\\") == said


def chat_schema():
    from pyspark.sql import types as T
    return T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])


def test_token_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = {}
    for k in range(3):
        lengths = rng.integers(0, 40, 50)
        ids = np.concatenate([np.append(rng.integers(1, 9, n), 0) for n in lengths] + [rng.integers(1, 9, 5 * k)])
        (tmp_path / f"f{k}").write_bytes(ids.astype("<u2").tobytes() + b"\1" * (k == 2))
        want.update({(f"f{k}", i): (int(n), True) for i, n in enumerate(lengths)})
        if k:
            want[(f"f{k}", 50)] = (5 * k, False)
    (tmp_path / "empty").write_bytes(b"")
    files = spark.createDataFrame([(f"f{k}",) for k in range(3)] + [("empty",)], "file string")
    for block in (4, 14, 1 << 20):
        got = {(r["file"], r["ordinal"]): (r["n_tokens"], r["closed"]) for r in tokenscan.scan(files, str(tmp_path), 0, 2, block).collect()}
        assert got == want


def test_embedding_links_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, None, 1),
            (8, [1.0, 0.0], None), (9, [1.0, 0.1], 1), (10, [0.0, 1.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [], 1)]
    out = {r[0]: tuple(r)[1:] for r in imi.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {k: out[k] for k in (1, 2, 3, 9)} == {k: (3, 1) for k in (1, 2, 3, 9)}
    assert all(out[k] == (0, k) for k in (4, 5, 6, 7, 8, 10, 11, 12)) and len(out) == 12


def test_embedding_links_of_any_length_and_size(spark):
    prepare(spark)
    rows = [(1, [1.0] * 4, 0), (2, [1.0] * 4100, 0), (3, [2.0] * 4, 0), (4, [3.0] * 4100, 0), (5, [1e200, 0.0], 0), (6, [2e200, 1e190], 0), (7, [1e-200, 0.0], 0),
            (8, [0.0, 1e-200], 0), (9, [float("inf"), 1.0], 0), (10, [float("nan"), 1.0], 0), (11, [0.0, 0.0], 0), (12, [], 0), (13, None, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in imi.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 2), 5: (2, 5), 6: (2, 5), 7: (2, 5), **{k: (0, k) for k in range(8, 14)}}


def test_chat_turns_without_parts_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", [("text", "hi", None, None, None, None, None)])], "conv_id long, turn long, role string, parts array<struct<" + ",".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in chat.PART.fields) + ">>")
    got = chat.read_back(chat.format_conversations(df)).first()
    assert [tuple(t) for t in got["turns"]] == [("user", ""), ("assistant", "hi")] and got["loss"] == ["hi"]


def test_embedding_links_lose_none(spark):
    rng = np.random.default_rng(4)
    wide = rng.normal(size=(600, 16)) * np.arange(1, 17.0) ** -1.0
    sets = [rng.normal(size=(1500, 4)), np.concatenate([wide, wide + 0.25 * rng.normal(size=wide.shape) * np.arange(1, 17.0) ** -1.0])]
    rows, want = [], {}
    for label, x in enumerate(sets):
        x = x.astype(np.float32).astype(float)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        near = unit @ unit.T >= 0.93
        for k in range(len(x)):
            rows.append((10_000 * label + k, x[k].tolist(), label))
            want[10_000 * label + k] = int(near[k].sum()) - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for p in (imi.IndexParams(per_cell=8, block=32), imi.IndexParams()):
        assert {r["vec_id"]: r["n_links"] for r in imi.links(df, p).collect()} == want


@pytest.mark.parametrize("module", [chat, imi])
def test_oracles(spark, module):
    ok, msg = compare(module.query(spark, SF001), module.ORACLE, duck(SF001))
    assert ok, msg
