"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Session settings that every operator of this package relies on."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")      # long texts make smaller batches
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")     # ranks are cut off before the shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlens-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends there, and a lost
    executor costs no earlier work. With ``by``, in a folder for each of these columns' values."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more, by the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column written as text, modulo ``m``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """Add columns computed per Arrow batch. ``make()`` runs once per task and returns a function from a
    record batch to one Arrow array per field."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            new = step(b)
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bounded_sample(df: DataFrame, by: str, per_value: int, key: str, size: int | None = None, labels: DataFrame | None = None) -> list[dict]:
    """At most ``per_value`` rows for each value of ``by`` (a column of few values): those with the smallest hashes of ``key`` and
    the column ``text``, the same rows whatever the partitioning; each as key, value and text. ``labels``: a table (key, by) that is joined
    where ``df`` has no such column. With ``size``, so many fewer of a value whose texts are long that about ``size`` bytes are expected, at least one.

    Rows are chosen without their texts, which are then looked up by a broadcast of the few that were chosen; each task keeps no more than
    ``per_value`` rows of a value, and no more reach the driver."""
    hashed = df.select(F.col(key).alias("k"), F.col("text"), F.xxhash64(F.col(key).cast("string"), F.col("text")).alias("h"), *([] if labels is not None else [F.col(by).alias("v")]))
    slim = hashed.withColumn("octets", F.octet_length("text")).drop("text")
    if labels is not None:
        slim = slim.join(labels.select(F.col(key).alias("k"), F.col(by).alias("v")), "k")
    counts = {r[0]: (r[1], r[2]) for r in slim.groupBy("v").agg(F.count("*"), F.sum("octets")).collect() if r[0] is not None}
    bound = {v: per_value if size is None or not b else max(1, min(per_value, size * n // b)) for v, (n, b) in counts.items()}
    w = Window.partitionBy("v").orderBy("h", "k")

    def smallest(values: list, share: Callable) -> list:
        some, most = F.lit(False), F.lit(0)
        for v in values:
            own = F.col("v") == F.lit(v)
            some, most = some | (own & share(v)), F.when(own, F.lit(bound[v])).otherwise(most)
        return slim.where(some).withColumn("no", F.row_number().over(w)).where((F.col("no") <= per_value) & (F.col("no") <= most)).select("v", "k", "h").collect()

    def low(v) -> Column:
        # more than the share that is wanted, so that hardly any rows but those are sorted
        n = counts[v][0]
        cut = int(min(1.0, (1.5 * bound[v] + min(200, bound[v] + 20)) / n) * (2**64)) - 2**63
        return F.col("h") <= F.lit(min(cut, 2**63 - 1))

    rows = smallest(list(counts), low) if counts else []
    got: dict = {}
    for r in rows:
        got[r["v"]] = got.get(r["v"], 0) + 1
    # where rows share hashes (one id and text, many times), a share of the hashes may hold too few of them
    few = [v for v in counts if got.get(v, 0) < min(bound[v], counts[v][0])]
    if few:
        rows = [r for r in rows if r["v"] not in few] + smallest(few, lambda v: F.lit(True))
    if not rows:
        return []
    wanted = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in {r["h"] for r in rows}], "h long"))
    texts = {(r["k"], r["h"]): r["text"] for r in hashed.select("k", "h", "text").join(wanted, "h").groupBy("k", "h").agg(F.first("text").alias("text")).collect()}
    return [{key: r["k"], by: r["v"], "text": texts[r["k"], r["h"]]} for r in sorted(rows, key=lambda r: (r["h"], str(r["k"])))]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public-domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(lengths: np.ndarray) -> np.ndarray:
    """Index of each element within its run, for runs of the given lengths laid end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
