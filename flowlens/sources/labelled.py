"""Labelled flow datasets.

Files of one header and encoding are one scan. Row caps are by position: one pass counts the
rows of each (file, block), whose prefix sums number the rows of split files without a sort
or a shuffle of rows, so "the first n rows of each file" is exact and stays distributed.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.split import seeded_sample
from flowlens.sources.io import materialize

TEXT_COLUMNS = ("Flow ID", "Source IP", "Destination IP", "Timestamp")


def _read(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(paths)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """CSV text -> double for every feature column ('Infinity', 'NaN' parse; text -> null)."""
    return df.select(*[F.col(c) if c in exclude else F.col(c).try_cast("double").alias(c) for c in df.columns])


def _headers(spark: SparkSession, files: list[str], encodings: dict[str, str]) -> dict[str, tuple[str, ...]]:
    header = {}
    for f in files:
        try:
            header[f] = tuple(_read(spark, [f], encodings.get(f, "UTF-8")).columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"file not found: {f}")
    if not header:
        raise FileNotFoundError("no data files found")
    return header


def _uris(df: DataFrame) -> list[str]:
    """The files of a scan, written as in ``_metadata.file_path``."""
    return sorted(u.replace("file:///", "file:/", 1) for u in df.inputFiles())


def _first_rows(df: DataFrame, uris: list[list[str]], rows_per_file: int | None, target_rows: int | None):
    """(first rows of the files, their number): files in the order of ``uris`` (the parts of each given path, in order),
    at most ``rows_per_file`` of each, no further file once ``target_rows`` are reached. One row per (file, block)
    reaches the driver, 128 MB of text each by default. The rows are stored and counted, as Spark may split the files
    otherwise when executors come or go between the two passes; then both are done again."""
    for _ in range(5):
        rows, total = _take(df, uris, rows_per_file, target_rows)
        rows = materialize(rows, "first_rows")
        if rows.count() == total:
            return rows, total
    raise RuntimeError("the files were split differently in each pass")


def _take(df: DataFrame, uris: list[list[str]], rows_per_file: int | None, target_rows: int | None):
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                             "_id": F.monotonically_increasing_id()})
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_from")).collect()
    by_file: dict[str, list] = {}
    for r in sorted(blocks, key=lambda r: r["_block"]):
        by_file.setdefault(r["_file"], []).append(r)
    kept, total = [], 0
    for parts in uris:
        left = rows_per_file
        for r in (r for u in parts for r in by_file.get(u, [])):
            n = r["n"] if left is None else min(left, r["n"])
            left = None if left is None else left - n
            total += n
            if n:
                kept.append((r["_file"], r["_block"], r["_from"], n))
        if target_rows is not None and total >= target_rows:
            break
    spark = df.sparkSession
    take = spark.createDataFrame(kept, "_file string, _block bigint, _from bigint, _n bigint")
    rows = placed.join(take, ["_file", "_block"]).filter(
        (F.col("_id") >= F.col("_from")) & (F.col("_id") < F.col("_from") + F.col("_n")))
    # a row's hash of file, block and place: the same rows are drawn however the job is run
    rows = rows.withColumn("_hash", F.md5(F.concat_ws("|", "_file", "_block", (F.col("_id") - F.col("_from")).cast("string"))))
    return rows.drop("_file", "_block", "_id", "_from", "_n"), total


def read_labelled(spark: SparkSession, files: list[str], rows_per_file: int | None = None,
                  target_rows: int | None = None, label: str = "Label", sample: bool = False,
                  keep_text: tuple[str, ...] = TEXT_COLUMNS, encodings: dict[str, str] | None = None) -> DataFrame:
    """A5: concatenate labelled CSV files by column name. Missing files (any URI Spark reads) warn; none found raises.

    ``rows_per_file`` takes the first rows of each file, by position. With ``target_rows`` no further file is read once
    the running total reaches it; with ``sample`` a seeded sample of exactly ``target_rows`` rows stays of a larger total.
    ``encodings`` names the encoding of files that are not UTF-8. Empty files have no rows and no columns."""
    encodings = encodings or {}
    header = _headers(spark, files, encodings)
    groups: dict[tuple, list[str]] = {}
    for f, h in header.items():
        groups.setdefault((h, encodings.get(f, "UTF-8")), []).append(f)
    capped = rows_per_file is not None or target_rows is not None

    def union(parts: list[DataFrame]) -> DataFrame:
        df = None
        for p in parts:
            p = p.toDF(*[c.strip() for c in p.columns])
            df = p if df is None else df.unionByName(p, allowMissingColumns=True)
        return df

    if not capped:
        # one read for the files of each header: a file's values belong to its own header's names
        df = union([_read(spark, members, enc) for (_, enc), members in groups.items()])
    else:
        # neighbours of one header and encoding are one scan; a scan is only counted while rows are missing
        runs: list[tuple[tuple, list[str]]] = []
        for f, h in header.items():
            key = (h, encodings.get(f, "UTF-8"))
            if runs and runs[-1][0] == key:
                runs[-1][1].append(f)
            else:
                runs.append((key, [f]))
        parts, total = [], 0
        for (_, enc), members in runs:
            uris = [_uris(_read(spark, [f], enc)) for f in members]
            part, n = _first_rows(_read(spark, members, enc), uris, rows_per_file,
                                  None if target_rows is None else target_rows - total)
            parts.append(part)
            total += n
            if target_rows is not None and total >= target_rows:
                break
        df = union(parts)
        if sample and target_rows is not None and total > target_rows:
            df = seeded_sample(df, target_rows, "_hash")
        df = df.drop("_hash")
    text = {label.strip(), "source_file", *keep_text}
    return numeric_columns(df, tuple(c for c in df.columns if c in text))


def read_labelled_with_fallback(spark: SparkSession, files: list[str], **kw) -> DataFrame:
    """UTF-8 first; a file with a line that is not valid UTF-8 is read as ISO-8859-1, which never fails. One pass over
    the files' bytes decides for each of them; caps, label and text columns hold for both. Other arguments as for
    ``read_labelled``."""
    present = list(_headers(spark, files, {}))
    # the text source keeps raw bytes; at most one row per file reaches the driver
    bad = {r["p"] for r in spark.read.text(present).filter(~F.is_valid_utf8(F.col("value")))
           .select(F.col("_metadata.file_path").alias("p")).distinct().collect()}
    latin = {f: "ISO-8859-1" for f in present if bad & set(_uris(spark.read.text(f)))}
    return read_labelled(spark, present, encodings=latin, **kw)
