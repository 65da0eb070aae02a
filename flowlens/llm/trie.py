r"""Conversation prefix trie, rolled up by bands of depth.

A node is a distinct sequence of first turns (role, text); its key is the exclusive or of 128-bit hashes of (turn, position), so a
prefix's key is a running aggregate, and a conversation is read in blocks of rows whose sums are carried on: one that holds a third of all rows is
not one task's.

Subtree totals come by depth bands. A band is ``height`` levels; a node sends what it counts to its ancestors inside its band
alone, at most ``height`` rows. That completes the deepest band. Each band root's total then goes to the root of the band above, band after band from the
deepest, over rows for band roots only; at the end every completed root is added to the ancestors in the band above it, again at
most ``height`` rows. Rounds are depth / height, rows at most 2 x ``height`` a node. The height is 8, or the square root of the greatest depth where that is
more, so neither outgrows the other. No step follows one parent pointer after another.

The digest of the conversations that end in a node runs over all of them in order. Their ids are sorted by range and joined as text to
blocks of up to ``chunk`` ids, in as many tasks as there are ranges; only these blocks meet in one task, which feeds them
to the hash one by one.

Defined results: a null role or text counts as empty; turns are ordered by turn (null first), equal ones by the first 32 characters of role and of
text, then by the digest of both, so repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out;
very long texts count whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import prepare, stored, table

HOT = 1000                                                   # at least so many children, and more than one node in HOT: at most HOT such parents
NONE = hashlib.sha256(b"").hexdigest()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, block, at (0 for a conversation's first turn), t1, t2 (hashes of role and text), chars.

    Rows are laid out by ranges of the whole order, which cut long conversations into blocks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, 32).alias("r"), F.substring(text, 1, 32).alias("t"),
        F.md5(F.concat(role, F.lit("\0"), text)).alias("d"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.char_length(text).cast("long").alias("chars"))
    order = ["turn", "r", "t", "d"]
    # repeated rows are alike in all that follows, so any of their orders will do; the id lets a range end among them
    rows = rows.withColumn("i", F.monotonically_increasing_id())
    laid = rows.repartitionByRange(shuffles(rows.sparkSession), "conv_id", *order, "i").withColumn("block", F.spark_partition_id())
    w = Window.partitionBy("conv_id", "block").orderBy(*order, "i")
    laid = stored(laid.select("conv_id", "block", "turn", "r", "t", "d", "i", "t1", "t2", "chars"), "turns")
    return carried(laid.select("conv_id", "block", "t1", "t2", "chars", F.row_number().over(w).alias("local")), F.max("local"), F.sum,
                   lambda before: (F.col("local") + F.coalesce(before, F.lit(0)) - 1).cast("long").alias("at"), ["conv_id", "block", "t1", "t2", "chars"])


def carried(rows: DataFrame, total: Column, over, last, keep: list[str]) -> DataFrame:
    """Carry each block's total on to the later blocks of its conversation: there are a few rows for each conversation."""
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "block").agg(total.alias("total")).select("conv_id", "block", over("total").over(w).alias("before"))
    return rows.join(before, ["conv_id", "block"]).select(*keep, last(F.col("before")))


def rebuild(turns: DataFrame, head: Column, most: int, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """Each conversation takes its first ``head`` (at most ``most``) turns from the one whose id is c - c % group, and its own from there on.

    Returns the turns (conv_id, block, at, t1, t2, chars) and the conversations (conv_id, n)."""
    of_block = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    convs = of_block.groupBy("conv_id").agg(F.sum("n").alias("own")).select(
        "conv_id", "own", head.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = convs.where("conv_id = base").select("base", F.least("own", F.lit(most)).alias("has"))
    convs = stored(convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0)))), "conversations")
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "chars")
    taken = convs.where("k > 0").select("conv_id", "base", "k").join(first, "base").where("at < k").select("conv_id", F.lit(-1).alias("block"), "at", "t1", "t2", "chars")
    # h and k travel by (conversation, block), so that a long conversation's rows stay apart
    given = of_block.select("conv_id", "block").join(convs.select("conv_id", "h", "k"), "conv_id")
    own = turns.join(given, ["conv_id", "block"]).where("at >= h").select("conv_id", "block", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "t1", "t2", "chars")
    return own.unionAll(taken), convs.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the node), p1, p2 (its parent), chars."""
    out = turns.select("conv_id", "block", "at", "chars", F.xxhash64("t1", "at").alias("m1"), F.xxhash64("t2", "at").alias("m2"))
    w = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = out.select("*", F.bit_xor("m1").over(w).alias("x1"), F.bit_xor("m2").over(w).alias("x2"))
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("a"), F.bit_xor("m2").alias("b")).select(
        "conv_id", "block", F.coalesce(F.bit_xor("a").over(blocks), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("b").over(blocks), F.lit(0)).alias("b"))
    k1, k2 = F.col("x1").bitwiseXOR(F.col("a")), F.col("x2").bitwiseXOR(F.col("b"))
    return local.join(before, ["conv_id", "block"]).select(
        "conv_id", (F.col("at") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("m1")).alias("p1"), k2.bitwiseXOR(F.col("m2")).alias("p2"), "chars")


def rollup(nodes: DataFrame, path: DataFrame, values: list[str], height: int | None = None) -> DataFrame:
    """Sum ``values`` of every node over its subtree, itself included: (k1, k2, values).

    ``nodes``: conv_id (one member), depth, k1, k2 and the values. ``path``: conv_id, depth, k1, k2 of all nodes that the members pass."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    height = height or max(8, math.isqrt(depth))
    band = F.floor(F.col("depth") / height).cast("long")
    sums = [F.sum(v).alias(v) for v in values]
    # of each conversation, the nodes of a band that it passes: at most ``height``
    steps = stored(path.groupBy("conv_id", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2"))).alias("steps")), "band-steps")
    own = nodes.withColumn("band", band)
    inside = own.join(steps, ["conv_id", "band"]).select(
        F.explode(F.filter("steps", lambda s: s["depth"] <= F.col("depth"))).alias("s"), *values).groupBy("s.k1", "s.k2").agg(*sums)
    inside = stored(inside, "band-inside")
    if depth < height:
        return inside
    above = steps.withColumn("band", F.col("band") + 1)
    roots = own.where((F.col("depth") % height == 0) & (F.col("depth") > 0)).drop(*values).join(inside, ["k1", "k2"]).join(above, ["conv_id", "band"])
    roots = stored(roots.select("band", "k1", "k2", "steps", F.col("steps")[0]["k1"].alias("r1"), F.col("steps")[0]["k2"].alias("r2"), *values), "band-roots", "band")
    done, complete = None, []
    for b in range(depth // height, 0, -1):
        here = roots.where(F.col("band") == b)
        if done is not None:
            below = done.groupBy(F.col("r1").alias("k1"), F.col("r2").alias("k2")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
            here = here.join(below, ["k1", "k2"], "left").select(
                "band", "k1", "k2", "steps", "r1", "r2", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
            here = stored(here, "band-complete")
        done = here
        complete.append(here)
    # each completed root goes to all ancestors in the band above
    rows = inside.select("k1", "k2", *values)
    for some in complete:
        rows = rows.unionAll(some.select(F.explode("steps").alias("s"), *values).select("s.k1", "s.k2", *values))
    return rows.groupBy("k1", "k2").agg(*sums)


def digests(ends: DataFrame, chunk: int = 20_000) -> DataFrame:
    """(k1, k2, conv_id) -> (k1, k2, digest of the ids in ascending order, as text, joined by commas)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, no, key, held = TaskContext.get().partitionId(), 0, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([block], pa.int32()),
                                               pa.array([no], pa.int64()), pa.array([",".join(held)])], names=["k1", "k2", "block", "no", "ids"])

        for b in batches:
            for a, c, i in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held and (key != (a, c) or len(held) >= chunk):
                    yield out()
                    no, held = no + 1, []
                key = (a, c)
                held.append(str(i))
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            done = []
            for a, c, text in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("k1", "k2", "ids")), strict=True):
                if key == (a, c):
                    h.update(b",")
                else:
                    if key:
                        done.append((*key, h.hexdigest()))
                    key, h = (a, c), hashlib.sha256()
                h.update(text.encode())
            if done:
                yield made(done)
        if key:
            yield made([(*key, h.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    n = shuffles(ends.sparkSession)
    ends = ends.select("k1", "k2", "conv_id").repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    # the number of a task is that of its range
    blocks = stored(ends.mapInArrow(join, "k1 long, k2 long, block int, no long, ids string"), "ends")
    return blocks.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "block", "no").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, height: int | None = None) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, block, at, t1, t2, chars) of the conversations ``convs`` (conv_id, n turns)."""
    turns, convs = stored(prefixes(turns), "prefixes"), stored(convs, "members")
    key = ["k1", "k2"]
    root = [F.lit(0).cast("long").alias(c) for c in key]
    nodes = turns.groupBy(*key, "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                             F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    null = F.lit(None).cast("long")
    nodes = nodes.select(*key, "depth", "conv_id", "n_convs", "chars", "p1", "p2").unionAll(
        top.select(*root, F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long"), null, null))
    nodes = stored(nodes, "nodes")
    parents = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(parents, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    path = turns.select("conv_id", "depth", *key).unionAll(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *root))
    counted = nodes.select("conv_id", "depth", *key, (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    total = rollup(counted, path, ["n_leaves", "saved_tokens"], height)

    last = convs.where("n = 0").select("conv_id", *root).unionAll(
        turns.join(convs.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("conv_id", *key))
    out = stored(nodes.join(total, key).join(digests(last), key, "left"), "nodes")

    # a parent of a large share of all nodes is one of a few, and its row is sent to every task
    most = max(HOT, (nodes.count() or 0) // HOT)
    up = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(up.where(F.col("n_children") > most).drop("n_children"))
    near = out.join(hot, ["p1", "p2"])
    far = out.join(hot.drop("parent_conv_id"), ["p1", "p2"], "left_anti").join(up.where(F.col("n_children") <= most).drop("n_children"), ["p1", "p2"], "left")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"), *key, "p1", "p2"]
    return near.select(*cols).unionAll(far.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_conversation_trie: the trie of the rebuilt conversations."""
    prepare(spark)
    turns = stored(numbered(table(spark, sf_dir, "conversations")), "numbered")
    turns, convs = rebuild(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
    return trie(turns, convs).drop("k1", "k2", "p1", "p2")


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        left(coalesce(role, ''), 32), left(coalesce(text, ''), 32), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(CAST(c AS VARCHAR))), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i + 1]) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r
      FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, c - c % 100 AS base, xor(r, 4294967295) % 6 AS h FROM bits),
k AS (SELECT h.*, least(h, (SELECT count(*) FROM t WHERE t.c = base)) AS k FROM h),
v AS (SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.base AND t.pos < k.k
      UNION ALL SELECT k.c, t.pos - h + k.k, role, text FROM k JOIN t ON t.c = k.c AND t.pos >= h),
p AS (SELECT c, pos + 1 AS depth, text, string_agg(sha256(role || chr(0) || sha256(text)), '') OVER (PARTITION BY c ORDER BY pos) AS key FROM v
      UNION ALL SELECT c, 0, '', '' FROM k),
n AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved, left(key, 64 * (depth - 1)) AS up FROM p GROUP BY key, depth),
ch AS (SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
s AS (SELECT DISTINCT a.key, b.key AS below FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth),
tot AS (SELECT s.key, sum(n.saved) AS saved, count(*) FILTER (ch.key IS NULL) AS leaves FROM s JOIN n ON n.key = s.below LEFT JOIN ch ON ch.key = s.below GROUP BY s.key),
e AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
      FROM (SELECT c, max(depth) AS depth, max_by(key, depth) AS key FROM p GROUP BY c) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children,
  CAST(tot.leaves AS BIGINT) AS n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN tot USING (key) LEFT JOIN ch USING (key) LEFT JOIN e USING (key) LEFT JOIN n q ON n.depth > 0 AND q.key = n.up
"""
