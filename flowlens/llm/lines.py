r"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space (``[\x20\x09-\x0D]``) at both ends, A-Z lower-cased. Keys of at least ``least`` code points
that stand in at least ``docs`` documents lose all their lines but those of the largest doc_id that holds them.

The store of keys is a log-structured one (``LineRuns``). A run is a table of (key, doc_id, rank), sorted by key and bucketed, holding of
each key no more than its ``docs`` largest doc_ids: enough to tell that it is frequent, and who keeps it. Runs stand in levels.
A batch of new keys is laid out once in the runs' buckets and merge-anti-joined with every run: an entry that a run
already outdoes with ``docs`` larger doc_ids can change nothing and is not added; the others become a run of level 0. When a level has ``fan``
runs, they are merged into one of the next level. As runs share their buckets, the joins shuffle none of them. Batches may come
in any order; here they are ranges of doc_id from the largest down, so that a key which is settled stays out of all later batches.

Flow: (1) the parts of the input (``split`` to each of Spark's partitions, written once) yield their keys, as 128-bit hashes, of every key at most ``docs`` doc_ids for each
``flush`` lines: a line that a third of all documents hold is a few rows of each part. (2) Batches go into the runs. (3) Each part asks the
merged run for the keepers of its keys, once for each key. (4) Those and the part's texts meet sorted, verdicts first; lines
are dropped as the texts stream by. No text is held but the one at hand, and nothing is broadcast or collected but the bounds of the batches.

Defined results: a null or empty text is one empty line; repeated rows with one doc_id count as one document, and each
row keeps or loses its own lines; rows without doc_id count together as one document below all others; an empty table gives
an empty result; columns named n_lines and n_dropped are replaced, all others stay; a very long text is split whole. Lines are compared by a 128-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import discard, fresh, prepare, shared_path, spans, stored, table

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"                          # fixed values: white space of the key
NO_ID = -(2**63)                                             # stands for a null doc_id
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineParams:
    least: int = 20                # code points of a key
    docs: int = 3                  # documents that make a key frequent
    batches: int = 6
    fan: int = 3                   # runs of a level that are merged into one of the next
    split: int = 4                 # parts of an input partition
    flush: int = 500_000           # lines that a task reads before it sends their keys


def hashes(text: str | None, least: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(WHITE).lower()                      # of bytes: A-Z alone
        long_ = len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long_ else None)
    return out


def as_longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def largest(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """Positions of each key's ``most`` largest different doc_ids."""
    order = np.lexsort((~doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = new_key.copy()
    new[1:] |= d[1:] != d[:-1]
    order, new_key = order[new], new_key[new]
    rank = spans(np.diff(np.append(np.flatnonzero(new_key), len(order))))
    return order[rank < most]


def keys_of_parts(rows: DataFrame, bounds: list[int], p: LineParams) -> DataFrame:
    """(part, doc, text) -> (batch, part, h1, h2, doc); batch 0 holds the doc_ids from the largest bound on."""
    edges = np.array(sorted(bounds), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        docs: list[int] = []
        sizes: list[int] = []
        parts: list[int] = []
        read = 0

        def emit() -> Iterator[pa.RecordBatch]:
            h1, h2 = as_longs(digests)
            doc, part = (np.repeat(np.array(x, np.int64), sizes) for x in (docs, parts))
            for one in np.unique(part):
                own = np.flatnonzero(part == one)
                own = own[largest(h1[own], h2[own], doc[own], p.docs)]
                for lo in range(0, len(own), 100_000):
                    at = own[lo:lo + 100_000]
                    batch = len(edges) - np.searchsorted(edges, doc[at], side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), pa.array(part[at], pa.int32()), pa.array(h1[at]), pa.array(h2[at]), pa.array(doc[at])],
                                                     names=["batch", "part", "h1", "h2", "doc"])
            for x in (digests, docs, sizes, parts):
                x.clear()

        for b in batches:
            for part, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = hashes(text, p.least)
                read += len(lines)
                got = [h for h in lines if h]
                if got:
                    digests += got
                    docs.append(doc)
                    sizes.append(len(got))
                    parts.append(part)
                if read >= p.flush:
                    yield from emit()
                    read = 0
        yield from emit()

    return rows.select("part", "doc", "text").mapInArrow(run, "batch int, part int, h1 long, h2 long, doc long")


class LineRuns:
    """Levelled sorted runs of (h1, h2, doc, rank): for every key at most ``docs`` of its largest doc_ids, rank 1 the largest."""

    def __init__(self, spark: SparkSession, docs: int = 3, fan: int = 3):
        self.spark, self.docs, self.fan = spark, docs, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Add (h1, h2, doc) rows, in any order and with repeats."""
        new = self._ranked(keys.select(*KEY, "doc").repartition(self.buckets, *KEY))
        for name in self.runs():
            full = self.spark.table(name).where(F.col("rank") == self.docs).select(*(F.col(c).alias(f"run_{c}") for c in (*KEY, "doc")))
            new = new.join(full.hint("merge"), (F.col("run_h1") == F.col("h1")) & (F.col("run_h2") == F.col("h2")) & (F.col("run_doc") >= F.col("doc")), "left_anti")
        self._put(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            self._merge(self.levels[level], level + 1)
            level += 1

    def compacted(self) -> DataFrame:
        """All runs as one."""
        if len(self.runs()) > 1:
            self._merge(self.runs(), len(self.levels))
        return self.spark.table(self.runs()[0])

    def drop(self) -> None:
        self._remove(self.runs())

    def _ranked(self, keys: DataFrame) -> DataFrame:
        w = Window.partitionBy(*KEY).orderBy(F.desc("doc"))
        return keys.select(*KEY, "doc").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.docs)

    def _merge(self, names: list[str], level: int) -> None:
        names = list(names)
        # as plain files: Spark may take a union of bucketed tables for bucketed and yet read them without their buckets
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(self.paths[n] for n in names))
        self._put(self._ranked(rows.select(*KEY, "doc").repartition(self.buckets, *KEY)), level)
        self._remove(names)

    def _put(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _remove(self, names: list[str]) -> None:
        self.levels = [[n for n in level if n not in names] for level in self.levels]
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.paths.pop(name))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", p: LineParams = LineParams()) -> DataFrame:
    """The input's columns, ``text`` without its dropped lines, with n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    part, doc, body = (fresh(docs, c) for c in ("_part", "_doc", "_body"))
    own = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    split = F.spark_partition_id() * p.split + F.pmod(F.xxhash64(own, F.octet_length(text)), F.lit(p.split))
    rows = stored(docs.select("*", split.cast("int").alias(part), own.alias(doc)), "line-docs")
    cut = [k / p.batches for k in range(1, p.batches)]
    bounds = rows.agg(F.percentile_approx(doc, F.array(*map(F.lit, cut)), 1000)).first()[0] or []
    keys = stored(keys_of_parts(rows.select(F.col(part).alias("part"), F.col(doc).alias("doc"), F.col(text).alias("text")), sorted(set(bounds)), p), "line-keys", "batch")
    runs = LineRuns(spark, p.docs, p.fan)
    for batch in range(len(set(bounds)) + 1):
        runs.add(keys.where(F.col("batch") == batch))
    frequent = runs.compacted().groupBy(*KEY).agg(F.max("doc").alias("keep"), F.max("rank").alias("rank")).where(F.col("rank") == p.docs).drop("rank")
    asked = keys.select("part", *KEY).distinct()
    verdicts = stored(asked.join(frequent.hint("merge"), KEY), "line-verdicts")
    runs.drop()

    # each part's verdicts and then its texts
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != part]
    side, a, b, keep = (fresh(rows, c) for c in ("_side", "_h1", "_h2", "_keep"))
    first = verdicts.select(*none, F.col("part").alias(part), F.lit(0).alias(side), F.col("h1").alias(a), F.col("h2").alias(b), F.col("keep").alias(keep))
    long_ = F.lit(None).cast("long")
    then = rows.select(*(F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != part), part, F.lit(1).alias(side), long_.alias(a), long_.alias(b), long_.alias(keep))
    laid = first.unionAll(then).repartition(part).sortWithinPartitions(part, side)
    fields = [*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    names, kept = laid.columns, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col = {c: names.index(c) for c in (text, part, doc, side, a, b, keep)}
        now, keeper = None, {}
        for whole in batches:
            parts, sides = (np.array(whole.column(col[c])) for c in (part, side))
            new = np.ones(len(parts), bool)
            new[1:] = (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1])
            edge = [*np.flatnonzero(new).tolist(), len(parts)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if parts[lo] != now:
                    now, keeper = parts[lo], {}
                rows = whole.slice(lo, hi - lo)
                if not sides[lo]:
                    both = np.stack([np.array(rows.column(col[c])) for c in (a, b)], 1).astype(">i8").tobytes()
                    keeper.update(zip((both[k:k + 16] for k in range(0, len(both), 16)), rows.column(col[keep]).to_pylist(), strict=True))
                    continue
                texts, lines, dropped = [], [], []
                for d, t in zip(rows.column(col[doc]).to_pylist(), rows.column(col[text]).to_pylist(), strict=True):
                    drop = [h is not None and keeper.get(h, d) != d for h in hashes(t, p.least)]
                    lines.append(len(drop))
                    dropped.append(sum(drop))
                    texts.append("\n".join(x for x, gone in zip(t.split("\n"), drop, strict=True) if not gone) if dropped[-1] else t or "")
                out = [rows.column(names.index(c)) if c != text else pa.array(texts, pa.string()) for c in kept]
                yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    return laid.mapInArrow(run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_line_dedup: every document, with its lines counted and the kept ones hashed."""
    prepare(spark)
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS i, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT r, doc_id, i, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(i) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT i) >= 3),
m AS (SELECT k.*, keep IS NOT NULL AND keep <> i AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
