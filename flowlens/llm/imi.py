"""Near-duplicate embeddings by an inverted multi-index.

Each half of the (normalised) vectors has its own codebook, fitted on a bounded sample; the product of the two codebooks is a
grid of cells, and every vector lies in one cell. A query visits cells in order of distance (multi-sequence traversal
of the two sorted distance lists) and stops by a bound. The distance of a half to a cell is its distance to the plane
between the two codewords, so a cell beyond the bound cannot hold a partner:
``cosine >= c`` means ``|x - y|^2 <= 2 - 2c``. The plane between the cells of x and y has x on one side and y on the other, so the
distances of both to it add up to at most their distance, in each half. With a and b the pairs of plane distances of x and of y,
``|a|^2 + |b|^2 <= |a + b|^2 <= 2 - 2c``: one of the two lies within half of the bound. So each vector visits the cells within
half of the bound (``reach=0.5``), a pair counts whichever side finds it, and no link is lost. All pairs met are verified in
double precision.

Cells next to one another in number form a group of about ``block`` vectors; a vector is sent once to each group that holds a cell it visits.
Only labels that are equal and not null are compared. Of vectors that are equal, one stands for all (a hash aggregation),
so a huge group of copies costs one vector. A pair that both sides find counts once. Groups are compared as
blocks of bounded size, as many tasks as needed; a block yields for each vector how many links it has there and one
edge to the smallest vector of its piece, never the pairs.

Defined results: vectors that are null, empty, all zero, or that hold null or non-finite components link with nothing, nor do rows without a
label; vectors of different length do not link; equal vectors link with one another; a repeated vec_id is a vector each time, and its
rows count as one vertex (their links add up); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import prepare, stored, table
from flowlens.llm.graph import components


@dataclass(frozen=True)
class IndexParams:
    cosine: float = 0.93
    reach: float = 0.5             # share of the exact bound that the traversal of either side goes to; from 0.5 on no link is lost
    sample: int = 8192             # bound of the vectors that codebooks are fitted on
    per_cell: int = 24             # vectors of a label that a cell should hold
    max_codewords: int = 128       # per half
    rounds: int = 6
    block: int = 1024              # vectors on either side of one comparison
    seed: int = 3


def codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, 1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def plane_distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the squared distance of the row to the region of every codeword (a lower bound)."""
    d = ((x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T)
    own = np.argmin(d, 1)
    between = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(2), 1e-24))
    low = np.maximum(d - d[np.arange(len(x)), own][:, None] - 1e-13, 0) / (2 * between[own])      # rounding may only lower it
    low[np.arange(len(x)), own] = 0
    return own, low**2


def traverse(a: np.ndarray, b: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Multi-sequence traversal of one query's two distance lists: the cells (i, j) with a[i] + b[j] <= bound, nearest
    first."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[i], b[j]
    upto = np.searchsorted(sb, bound - sa + 1e-12, side="right")    # how far the second list is walked for each of the first
    first = np.repeat(np.arange(len(sa)), upto)
    second = np.arange(int(upto.sum())) - np.repeat(np.cumsum(upto) - upto, upto)
    order = np.argsort(sa[first] + sb[second], kind="stable")
    return i[first[order]], j[second[order]]


def fit(vectors: DataFrame, n: int, labels: int, p: IndexParams) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks for each vector length, from a bounded sample chosen by hash."""
    share = min(1.0, 1.3 * p.sample / max(n, 1))
    cut = int(share * 2**64) - 2**63
    rows = vectors.where(F.xxhash64("vec_id") <= F.lit(min(cut, 2**63 - 1))).select("vec_id", "unit").limit(2 * p.sample).collect()
    by_size: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["vec_id"])[: p.sample]:
        by_size.setdefault(len(r["unit"]), []).append(r["unit"])
    out = {}
    k = int(np.clip(np.ceil(np.sqrt(n / max(labels, 1) / p.per_cell)), 1, p.max_codewords))
    for size, x in by_size.items():
        x = np.array(x)
        half = size // 2
        out[size] = tuple(codebook(part, min(k, len(x)), p.rounds, p.seed + s) if part.shape[1] else np.zeros((1, 0))
                          for s, part in enumerate((x[:, :half], x[:, half:])))
    return out


def pieces_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex that each of ``n`` vertices reaches over the edges (a, b)."""
    low = np.arange(n)
    while True:
        m = low.copy()
        np.minimum.at(m, a, low[b])
        np.minimum.at(m, b, low[a])
        m = m[m]
        if (m == low).all():
            return low
        low = m


def links(vectors: DataFrame, p: IndexParams = IndexParams()) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    # squares of very large or small components leave the range of doubles; a power of two in front changes no other digit
    most = F.aggregate("embedding", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    scale = F.when((most > 0) & (most < float("inf")), F.pow(F.lit(2.0), F.floor(F.log2(most)).cast("double"))).otherwise(1.0)
    rows = rows.withColumn("scale", scale)
    norm = F.col("scale") * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.col("scale")) * (x / F.col("scale"))))
    # a null component makes the norm null, one that is not finite makes it NaN or infinite
    rows = rows.withColumn("norm", norm).drop("scale")
    usable = F.col("label").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    good = rows.where(usable)
    key = ["label", "embedding"]
    same = good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("norm").alias("norm"))
    reps = stored(same.select("rep", "copies", "norm", *key, F.transform("embedding", lambda x: x / F.col("norm")).alias("unit")), "reps")
    n, labels = reps.agg(F.count("*"), F.count_distinct("label")).first()
    member = good.join(reps.select("rep", "copies", *key), key).select("vec_id", "rep", "copies")
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).distinct()
    # a vertex is a class: a row of equal vectors and label, named by its own number, as vec_ids may repeat
    reps = reps.withColumn("node", F.xxhash64("rep", "label", "embedding"))
    books = spark.sparkContext.broadcast(fit(reps.withColumn("vec_id", F.col("rep")), n, labels, p))
    bound = (2 - 2 * p.cosine) * p.reach
    width = max(1, p.block // p.per_cell)                            # cells of a group
    sent_type = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    label_key = F.xxhash64("label", F.size("embedding")).alias("label")      # vectors of other lengths meet nowhere

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, unit = (c.to_pylist() for c in batch.columns)
            out: dict[str, list] = {c: [] for c in ("label", "cell", "node", "probe", "home", "met")}
            by_size: dict[int, list[int]] = {}
            for k, u in enumerate(unit):
                by_size.setdefault(len(u), []).append(k)
            for size, rows_ in by_size.items():
                if size not in books.value:        # a length that the sample missed: one cell for all of it
                    book = (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))
                else:
                    book = books.value[size]
                x = np.array([unit[k] for k in rows_]).reshape(len(rows_), size)
                own1, low1 = plane_distances(x[:, :size // 2], book[0])
                own2, low2 = plane_distances(x[:, size // 2:], book[1])
                wide = len(book[1])
                for r, k in enumerate(rows_):
                    i, j = traverse(low1[r], low2[r], bound)
                    home = (int(own1[r]) * wide + int(own2[r])) // width
                    groups = np.unique((i * wide + j) // width)
                    seen = np.zeros(len(book[0]) * wide // width + 1, bool)
                    seen[groups] = True
                    met = np.packbits(seen, bitorder="little").tobytes()
                    for g in [home, *groups[groups != home].tolist()]:
                        out["label"].append(label[k])
                        out["cell"].append(g)
                        out["node"].append(node[k])
                        out["probe"].append(g != home)
                        out["home"].append(home)
                        out["met"].append(met if g == home else None)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("label", pa.int64()), ("cell", pa.int64()), ("node", pa.int64()),
                                                                    ("probe", pa.bool_()), ("home", pa.int64()), ("met", pa.binary())]))

    schema = "label long, cell long, node long, probe boolean, home long, met binary"
    placed = reps.select("node", label_key, "unit").repartition(max(8, spark.sparkContext.defaultParallelism * 4), "node").mapInArrow(assign, schema)
    placed = stored(placed, "cells")
    size = placed.groupBy("label", "cell").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("members"))
    # blocks: members against members (each pair of blocks once), and probes against members
    size = size.where("members > 0 and members + probes > 1").select(
        "label", "cell", F.ceil(F.col("members") / p.block).cast("long").alias("mb"), F.ceil(F.col("probes") / p.block).cast("long").alias("pb"))
    at = placed.join(size, ["label", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("pb")).otherwise(F.col("mb"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    meets = (F.when(F.col("probe"), F.transform(upto("mb"), lambda m: F.struct(m.alias("m"), (F.col("own") + F.col("mb")).alias("o"))))
             .otherwise(F.concat(
                 F.transform(upto("mb"), lambda m: F.struct(F.least(m, "own").alias("m"), F.greatest(m, "own").alias("o"))),
                 F.when(F.col("pb") > 0, F.transform(upto("pb"), lambda o: F.struct(F.col("own").alias("m"), (o + F.col("mb")).alias("o"))))
                 .otherwise(F.array().cast("array<struct<m:bigint,o:bigint>>")))))
    sent = at.select("label", "cell", "node", "home", "met", "own", "probe", F.explode(meets).alias("b")).select(
        "label", "cell", F.col("b.m").alias("m"), F.col("b.o").alias("o"), "node", "home", "met",
        F.when(F.col("probe"), F.col("own") + F.lit(1 << 40)).otherwise(F.col("own")).alias("side"))
    cosine = p.cosine

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        m = part["m"].iloc[0]
        left = (part["side"] == m).to_numpy()
        alone = m == part["o"].iloc[0]                            # a block with itself
        if left.all() and not alone:                              # no row hashed to the other block
            return pd.DataFrame({"node": [], "n": [], "root": []}, dtype=np.int64)
        node = part["node"].to_numpy()
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64) / part["norm"].to_numpy()[:, None]
        li, ri = np.flatnonzero(left), np.arange(len(node)) if alone else np.flatnonzero(~left)
        a, b = [], []
        for lo in range(0, len(li), 512):
            i, j = np.nonzero(x[li[lo:lo + 512]] @ x[ri].T >= cosine - 1e-9)
            i, j = li[lo + i], ri[j]
            keep = i < j if alone else slice(None)
            i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            a.append(i[exact])
            b.append(j[exact])
        a, b = (np.concatenate(v) if v else np.zeros(0, int) for v in (a, b))
        group = part["cell"].iloc[0]
        home = part["home"].to_numpy()
        if not alone and home[ri[0]] != group:                    # probes: a pair that both sides find counts in the higher group
            seen = np.zeros((len(node), 8 * len(part["met"].iloc[li[0]])), bool)
            seen[li] = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in part["met"].iloc[li]]), axis=1, bitorder="little")
            once = (home[b] < group) | ~seen[a, home[b]]
            a, b = a[once], b[once]
        low = pieces_of(a, b, len(node))
        # the number of linked vectors counts copies, which the other side's row knows
        used = np.unique(np.concatenate([a, b]))
        root = node[low[used]]
        copies = part["copies"].to_numpy()
        got = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        return pd.DataFrame({"node": node[used], "n": got[used].astype(np.int64), "root": root})

    # vectors join last, so that they cross the network once for each block
    sent = sent.join(reps.select("node", "copies", "norm", F.col("embedding").cast(sent_type).alias("embedding")), "node")
    found = stored(sent.groupBy("label", "cell", "m", "o").applyInPandas(compare, "node long, n long, root long"), "links")
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("n").alias("n"))
    vertex = reps.select("node", "rep", "copies", *key).join(total, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    vertex = vertex.withColumn("component", F.coalesce("component", "node"))
    low = vertex.groupBy("component").agg(F.min("rep").alias("component_id"))
    vertex = vertex.join(low, "component").select(*key, "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    member = good.join(vertex, key).select("vec_id", "links", "component_id")
    member = member.groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component_id").alias("component_id"))
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionAll(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_embedding_near_dedup: links and components of all embeddings with equal labels."""
    prepare(spark)
    out = links(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE n > 0 AND isfinite(n)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.a = vec_id
"""
