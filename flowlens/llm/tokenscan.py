"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but little-endian ids, one document after the other, each closed by an end-of-document
id. The files are cut into blocks of bounded size, wherever the cuts fall. Each block is searched for the end id in
one vectorised comparison and yields its closed counts, plus the tokens before its first end and after its last one. A
prefix scan over a file's blocks (a running maximum of the last end before each block) stitches the documents that cross
blocks. No index is read, and no file is read whole.

Defined results: an empty document counts 0 tokens (the end id is not counted); tokens behind the last end id of a file
are an open document (``closed`` false); a file whose size is no multiple of the id's width counts its last
bytes as no token; an empty file has no document; repeated paths are read once. Null and empty texts are written as
empty documents; rows with equal doc_id are documents each of their own; other columns of the input are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.bpe import WordBPE, vocabulary_path
from flowlens.llm.common import prepare, stored, table, texts_of
from flowlens.session import ensure_checkpoint_dir

BLOCK = 4 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI that every executor can open (file, s3, gs, hdfs)."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 50256, width: int = 2) -> DataFrame:
    """Write one flat token file per partition; returns (doc_id, file, ordinal), which must be stored at once, as that writes
    the files. A file is written under a name of its own and then renamed, so a task that runs again leaves whole files
    only; the name that counts is in the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        bpe = WordBPE(path, special=False)                       # a text must not hold the end id
        end = np.array([end_id], f"<u{width}").tobytes()
        n = 0
        out = None
        for b in batches:
            ids, got = texts_of(b, "doc_id"), texts_of(b, "text")
            out = out or fs.open_output_stream(f"{root}/{name}.part")
            for lo in range(0, len(got), 250):
                for raw in bpe.encode_batch(got[lo:lo + 250]):
                    out.write(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                    out.write(end)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(np.arange(n, n + len(ids)))], names=["doc_id", "file", "ordinal"])
            n += len(ids)
        if out:
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, file string, ordinal long")


def scan(files: DataFrame, folder: str, end_id: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file) names in ``folder`` -> (file, ordinal, n_tokens, closed), one row per document."""
    spark = files.sparkSession
    block -= block % width

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            names = b.column(0).to_pylist()
            info = fs.get_file_info([f"{root}/{n}" for n in names]) if names else []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.size // width for i in info], pa.int64())], names=["file", "tokens"])

    listed = files.select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    step = block // width
    blocks = listed.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(step).cast("long"))).alias("start"))
    blocks = blocks.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "file", "start")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            for name, tokens, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(start * width)
                    ids = np.frombuffer(f.read(min(step, tokens - start) * width), f"<u{width}")
                at = np.flatnonzero(ids == end_id) + start
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([start]), pa.array([start + len(ids)]), pa.array([len(at)], pa.int64()),
                    pa.array([at[-1] if len(at) else None], pa.int64()), pa.array([start + len(ids) == tokens]),
                    pa.array([at.tolist()], pa.list_(pa.int64()))],
                    names=["file", "start", "stop", "n", "last", "final", "ends"])

    found = stored(blocks.mapInArrow(ends, "file string, start long, stop long, n long, last long, final boolean, ends array<long>"), "ends")
    # prefix scan over each file's blocks: documents closed before this block, and where the last of them ended
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select("file", "start", "n", "last").select(
        "file", "start", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("closed_before"),
        F.coalesce(F.max("last").over(w), F.lit(-1)).alias("end_before"))
    whole = found.join(before, ["file", "start"])
    # the end before each end: the block's own, or what the scan carried in
    starts = F.concat(F.array("end_before"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    closed = whole.where("n > 0").select("file", "closed_before", F.posexplode(F.arrays_zip("ends", starts.alias("starts"))).alias("k", "z")).select(
        "file", (F.col("closed_before") + F.col("k")).alias("ordinal"), (F.col("z.ends") - F.col("z.starts") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    last_end = F.greatest(F.coalesce("last", F.lit(-1)), F.col("end_before"))
    tail = whole.where("final").where(F.col("stop") - 1 > last_end).select(
        "file", (F.col("closed_before") + F.col("n")).alias("ordinal"), (F.col("stop") - 1 - last_end).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionAll(tail)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_token_counts: tokens of every document, found again by scanning the flat token files it was written to."""
    prepare(spark)
    path = vocabulary_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        end = next(t["id"] for t in json.load(f)["added_tokens"] if t["content"] == "<|endoftext|>")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlens-llm/tokens-{uuid.uuid4().hex}"
    written = stored(write_token_files(table(spark, sf_dir, "documents"), folder, path, end), "token-manifest")
    counts = scan(written.select("file"), folder, end)
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
