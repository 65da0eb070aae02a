"""Near-duplicate documents by BagMinHash: signatures for weighted (multiset) Jaccard similarity.

A document is the multiset of its five-word shingles. For each shingle, the weight axis is cut into dyadic
intervals [0,1), [1,2), [2,4), ...; every interval has a Poisson process in time whose rate is the interval's length. A
point falls on one unit level of its interval and on one signature slot, both by hash, and counts only if the
document's weight reaches above that level. A slot keeps its earliest point, so two documents agree in a
slot with a probability that is exactly their weighted Jaccard similarity. Points later than the latest
slot so far are never made: a long document costs little more than one point per shingle.

Signatures are cut into bands. Documents that share a band are compared by the exact multiset overlap:

1. Equal texts form one class, named by a 64-bit hash; classes, not rows, are compared.
2. In every band bucket the smallest doc_id is the pivot, and the others are compared with it: as many pairs as members, never
   all pairs. Verified pairs are links. The pivot leaves its bucket, and buckets that still hold several components go on once
   more with four pivots of their largest component.
3. A pivot's signature, and for pairs that pass its shingles, is sent once to each block of its partners. Blocks are of
   bounded size, so a pivot with a third of all documents as partners is spread over many tasks.
4. What is then still apart is compared block by block: the members outside a bucket's largest component against all of its
   members. A task holds one block of the former, of bounded rows and bytes, and streams one block of the latter; it compares
   signatures as matrices, verifies what they let pass, and returns links between components only. So pairs are never rows,
   no bucket is ever collected, and no link between different components is lost. Only this step's arithmetic grows with the
   product of the two sides: documents that share a band and are no near-duplicates of the bucket's largest component.

Two exceptions to "every pair": those whose signatures agree in under ``FLOOR`` of the slots are skipped, at similarity 0.8
a chance of about 1e-6; and step 4 leaves a pair to the first band in which both signatures agree in 16 bits of each slot, which
is not a shared band with a chance of about 1e-5. Both are below the chance of sharing no band at all (5e-5).

Defined results: null texts and texts without a word are one document each, alone; a text of one to four words has
one shingle, all its words; repeated rows and equal texts are one group; of a group, the smallest doc_id stays,
and of rows that share it any one; an empty table gives an empty result; only
id and text are read, so other columns cannot clash. Rows with a null doc_id rank behind all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, mix64, prepare, spans, stored, table
from flowlens.llm.graph import components

WORDS, SIMILARITY, ROWS, BANDS, FLOOR, BLOCK = 5, 0.8, 5, 25, 0.62, 128
#: Bounds of one block in step 4.
BLOCK_ROWS, BLOCK_BYTES = 512, 8_000_000
#: Rows of the broadcast bitmap, 64 bits each.
BITMAP_ROWS = 1 << 20
U = np.uint64


class Words:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.known = limit, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [t.lower().split() if t else [] for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = set().union(*words)
        self.known.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))) for w in new)
        n = np.fromiter(map(len, words), np.int64, len(words))
        get = self.known.__getitem__
        return np.fromiter((h for ws in words for h in map(get, ws)), U, int(n.sum())), n


def shingles(h: np.ndarray, n: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of each text (all of a shorter one), and the text of each."""
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))
    s = np.zeros(len(h), U)
    for k in range(words):
        some = left > k
        i = np.flatnonzero(some)
        s[i] = (s[i] ^ h[i + k]) * U(0x9E3779B97F4A7C15) + U(k + 1)
        s[i] ^= s[i] >> U(29)
    keep = (left >= words) | ((n[doc] < words) & (spans(n) == 0))
    return mix64(s[keep]), doc[keep]


def multiset(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times), in no order that matters."""
    if not len(s):
        return doc, s, np.zeros(0, np.int64)
    key = mix64(s + doc.astype(U) * U(0x9E3779B97F4A7C15))      # the same shingle in two texts gets two keys
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return doc[order[start]], s[order[start]], np.diff(np.append(start, len(s)))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def bag_minhash(doc: np.ndarray, s: np.ndarray, times: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """One signature row of ``slots`` 64-bit values per text (0 where a text has no shingle)."""
    first = np.full(texts * slots, np.inf)
    sig = np.zeros(texts * slots, U)
    # one process for each shingle and dyadic interval below its weight
    level = np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(s)), level)
    k = spans(level)                                            # interval 0 is [0,1), k is [2^(k-1), 2^k)
    base = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    rate = np.where(k > 0, base, 1).astype(np.float64)
    state = mix64(s[which] + k.astype(U) * U(0xD1B54A32D192ED03))
    reach, owner = times[which], doc[which]
    t = np.zeros(len(which))
    while len(t):
        state = mix64(state + U(0x9E3779B97F4A7C15))
        t = t - np.log(uniform(state)) / rate
        pick = mix64(state ^ U(0xA0761D6478BD642F))
        slot = owner * slots + (((pick & U(0xFFFFFFFF)) * U(slots)) >> U(32)).astype(np.int64)
        hit = t < first[slot]
        hit &= base + (((pick >> U(32)) * rate.astype(U)) >> U(32)).astype(np.int64) < reach
        at, when = slot[hit], t[hit]
        np.minimum.at(first, at, when)
        won = when == first[at]
        sig[at[won]] = state[hit][won]
        go = t < first.reshape(texts, slots).max(1)[owner]
        state, t, rate, base, reach, owner = state[go], t[go], rate[go], base[go], reach[go], owner[go]
    return sig.reshape(texts, slots)


def class_key(text: str) -> F.Column:
    """A 64-bit key that equal texts share; null for null and empty texts."""
    return F.when(F.length(F.col(text)) > 0, F.xxhash64(F.col(text), F.octet_length(F.col(text))))


def by_blocks(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """The columns node and text in blocks of bounded size, texts without a word (for Python) left out."""
    for b in batches:
        nodes, texts, total = [], [], 0
        for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t and not t.isspace():
                nodes.append(node)
                texts.append(t)
                total += len(t)
                if total >= chars:
                    yield nodes, texts
                    nodes, texts, total = [], [], 0
        if nodes:
            yield nodes, texts


def signatures(texts: DataFrame, slots: int = ROWS * BANDS) -> DataFrame:
    """(node, text) -> (node, sig, bands): 16 bits of every slot, and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for nodes, got in by_blocks(batches):
            sig = bag_minhash(*multiset(*shingles(*words(got))), len(got), slots)
            key = np.zeros((len(got), BANDS), U)
            for r in range(ROWS):
                key = mix64(key ^ sig[:, r::ROWS][:, :BANDS]) + U(r + 1)
            key = mix64(key + np.arange(BANDS, dtype=U)[None, :]).astype(np.int64)
            short = (sig & U(0xFFFF)).astype("<u2")
            offsets = pa.array(np.arange(0, (len(got) + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.int64()), pa.array([r.tobytes() for r in short], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(key.ravel()))], names=["node", "sig", "bands"])

    return texts.select("node", "text").mapInArrow(run, "node long, sig binary, bands array<long>")


def bags(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, bag): sorted hashes of (shingle, occurrence), which overlap as the multisets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for nodes, got in by_blocks(batches):
            doc, s, times = multiset(*shingles(*words(got)))
            each = np.repeat(np.arange(len(s)), times)
            bag, owner = mix64(s[each] + spans(times).astype(U) * U(0xC2B2AE3D27D4EB4F)), doc[each]
            bag = bag[np.argsort(owner, kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(got)))])
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.int64()),
                pa.array([np.sort(bag[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "bag"])

    return texts.select("node", "text").mapInArrow(run, "node long, bag binary")


def within(data: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``data`` whose node is among those of ``keys``, and by chance a few others: a bitmap of at most ``BITMAP_ROWS`` rows
    is broadcast, so that rows no join will want are not shuffled. It grows no further with the input; with very many keys
    more rows pass. An exact join must follow."""
    word, bit = (F.expr(f"node & {BITMAP_ROWS - 1}L"), F.expr("shiftleft(1L, cast(shiftrightunsigned(node, 32) & 63 as int))"))
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    both = data.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return both.where("_bits & _bit <> 0").select(*data.columns)


def beside_pivots(pairs: DataFrame, data: DataFrame, value: str) -> DataFrame:
    """(a, b) pairs -> rows (a, node, is_pivot, value) laid out so that ``a``'s own row precedes those of its partners. It is
    sent once per block of about ``BLOCK`` partners."""
    blocks = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    member = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("node"))
    pivot = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    both = (member.withColumn("is_pivot", F.lit(False)).unionAll(pivot.withColumn("is_pivot", F.lit(True)))
            .join(within(data.select("node", value), nodes), "node"))
    return both.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("is_pivot")).select("a", "node", "is_pivot", value)


def overlaps(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two bags have a multiset Jaccard similarity of ``similarity`` or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def linked(pairs: DataFrame, sigs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs -> those whose multisets overlap by ``similarity`` or more. Signatures (250 bytes) go first; the shingles
    themselves are sent for pairs that agree in ``FLOOR`` of the slots."""

    def agree(x: np.ndarray, y: np.ndarray) -> bool:
        return (x == y).mean() >= FLOOR

    def compare(rows: DataFrame, kind: str, test) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = None
            for b in batches:
                found = []
                for a, node, is_pivot, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    v = np.frombuffer(v, kind)
                    if is_pivot:
                        mine = v
                    elif test(mine, v):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        return rows.mapInArrow(run, "a long, b long")

    likely = stored(compare(beside_pivots(pairs, sigs, "sig"), "<u2", agree), "likely")
    return compare(beside_pivots(likely, bag, "bag"), "<u8", lambda x, y: overlaps(x, y, similarity))


class Block:
    """The rows outside the largest component in one block of a bucket, and the components already linked there."""

    def __init__(self, key: tuple, similarity: float):
        self.key, self.similarity, self.rows, self.sig, self.root = key, similarity, [], None, {}

    def find(self, c: int) -> int:
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def links(self, rows: list[dict]) -> list[tuple[int, int]]:
        """Links of ``rows`` to the block that connect components not yet connected here."""
        if not self.rows or not rows:
            return []
        if self.sig is None:
            self.sig = np.stack([np.frombuffer(r["sig"], "<u2") for r in self.rows])
        other = np.stack([np.frombuffer(r["sig"], "<u2") for r in rows])
        agree = np.zeros((len(self.sig), len(other)), np.uint8)
        first = np.full(agree.shape, BANDS, np.uint8)
        for band in range(BANDS):
            whole = np.ones(agree.shape, bool)
            for k in range(band * ROWS, (band + 1) * ROWS):
                same = self.sig[:, k, None] == other[None, :, k]
                agree += same
                whole &= same
            first[whole & (first == BANDS)] = band
        a, b = (np.array([r["node"] for r in side]) for side in (self.rows, rows))
        twice = np.array([r["apart"] for r in rows])[None, :] & (b[None, :] < a[:, None])   # two rows of the block's kind
        out = []
        for i, j in np.argwhere((agree >= FLOOR * ROWS * BANDS) & (first == rows[0]["band"]) & ~twice).tolist():
            x, y = self.find(self.rows[i]["component"]), self.find(rows[j]["component"])
            if x != y and overlaps(np.frombuffer(self.rows[i]["bag"], "<u8"), np.frombuffer(rows[j]["bag"], "<u8"), self.similarity):
                self.root[x] = y
                out.append((self.rows[i]["node"], rows[j]["node"]))
        return out


def linked_apart(members: DataFrame, sigs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """(node, bucket, band, component) -> links (a, b) that connect all components of a bucket that any link connects."""
    sized = members.join(bag.select("node", F.octet_length("bag").alias("bytes")), "node")
    size = sized.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of = size.groupBy("bucket").agg(F.max(F.struct("n", "component", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES)).cast("long")

    of = of.select("bucket", F.col("top.component").alias("top"), blocks(F.col("n"), F.col("bytes")).alias("of_all"),
                   blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("of_apart"))
    rows = members.join(of.where("of_apart > 0"), "bucket").withColumn("apart", F.col("component") != F.col("top"))

    def dealt(rows, held, mine, others):
        """Each row in its own block of the ``mine`` ones, once for each of the ``others``."""
        at = F.pmod(F.xxhash64("node", F.lit(held)), F.col(mine)).alias("x" if held else "y")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias("y" if held else "x")
        return rows.select("node", "bucket", "band", "component", "apart", F.lit(held).alias("held"), at, each)

    mine, rest = dealt(rows.where("apart"), True, "of_apart", "of_all"), dealt(rows, False, "of_all", "of_apart")
    both = mine.unionByName(rest).join(within(sigs.select("node", "sig"), members), "node").join(within(bag.select("node", "bag"), members), "node")
    both = both.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", F.desc("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block((), similarity)
        for b in batches:
            found, wait = [], []
            for r in b.to_pylist():
                key = (r["bucket"], r["x"], r["y"])
                if key != block.key:
                    found += block.links(wait)
                    block, wait = Block(key, similarity), []
                (block.rows if r["held"] else wait).append(r)
            found += block.links(wait)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, doc_id, component): every class of texts with words, its smallest doc_id, and its group.

    ``docs`` has the columns doc_id and text. A group is what links of ``similarity`` or more connect."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "text", class_key("text").alias("node"))
    texts = texts.where("node is not null")
    classes = stored(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")
    sigs = stored(signatures(texts), "signatures")
    member = sigs.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = member.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    member = member.join(several.select("bucket"), "bucket").distinct().join(classes, "node")
    member = stored(member.select("node", "bucket", "band", "doc_id"), "buckets")
    # signatures and shingles of the candidates alone, one text of each class; inner joins (``wanted`` holds a class once), as
    # Catalyst would push a semi join below the bitmap
    wanted = member.select("node", "doc_id").distinct()
    sigs = stored(within(sigs.select("node", "sig"), wanted).join(wanted.select("node"), "node").dropDuplicates(["node"]), "sigs")
    bag = stored(bags(within(texts, wanted).join(wanted, ["node", "doc_id"]).dropDuplicates(["node", "doc_id"])), "bags")
    member = member.withColumn("component", F.col("node"))
    links = done = None
    for pivots in (1, 4, 0):
        size = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        many = size.groupBy("bucket").agg(F.count("*").alias("parts")).where("parts > 1").select("bucket")
        left = stored(member.join(size.join(many, "bucket"), ["bucket", "component"]), "open")
        if left.isEmpty():
            break
        if pivots:
            # pivots come from each bucket's largest component, so that those outside find a link soon
            order = Window.partitionBy("bucket").orderBy(F.desc("n"), "doc_id", "node")
            pick = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
            pick = pick.groupBy("bucket").agg(F.collect_list(F.struct("node", "component")).alias("pivots"))
            left = left.join(pick, "bucket")
            pairs = left.select("node", "component", F.explode("pivots").alias("p")).where("component <> p.component")
            pairs = pairs.select(F.least("p.node", "node").alias("x"), F.greatest("p.node", "node").alias("y"), F.col("p.node").alias("a"))
            pairs = pairs.groupBy("x", "y").agg(F.min("a").alias("a")).select("x", "y", "a")
            if done is not None:
                pairs = pairs.join(done, ["x", "y"], "left_anti")
            done = pairs = stored(pairs, "pairs")
            found = linked(pairs.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")), sigs, bag, similarity)
        else:
            found = linked_apart(left, sigs, bag, similarity)
        found = stored(found, "links")
        links = found if links is None else links.unionAll(found)
        parts = stored(components(links), "parts").withColumnRenamed("id", "node")
        if pivots:
            member = left.where(~F.exists("pivots", lambda p: p["node"] == F.col("node"))).select("node", "bucket", "band", "doc_id").join(
                parts, "node", "left").select("node", "bucket", "band", "doc_id", F.coalesce("component", "node").alias("component"))
    if links is None:
        return classes.select("node", "doc_id", F.col("node").alias("component"))
    return classes.join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id and class_id, the smallest doc_id of its group (its own if the text has no word)."""
    member = groups(docs, similarity)
    low = member.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_class = member.join(low, "component").select("node", "class_id")
    rows = docs.select("doc_id", class_key("text").alias("node"))
    return rows.join(of_class, "node", "left").select(
        "doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with all columns: one of each group, and every row whose text has no word."""
    node, doc = fresh(docs, "_node"), fresh(docs, "_doc")
    best = groups(docs, similarity).groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("k"))
    best = best.select(F.col("k.node").alias(node), F.col("k.doc_id").alias(doc))
    rows = docs.withColumns({node: class_key("text"), doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))})
    kept = rows.join(best, [node, doc], "left_semi").dropDuplicates([node, doc]).select(*docs.columns)
    return kept.unionAll(rows.where(F.col(node).isNull()).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_minhash_near_dedup: the near-duplicate group of every document; the smallest doc_id of a group is kept."""
    prepare(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that of the smallest doc_id."""
    prepare(spark)
    return deduplicated(docs)
