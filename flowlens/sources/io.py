"""Table readers shared by the sources.

A scan gets one task per file split (a parquet row group cannot be split). When an input
yields fewer splits than the cluster has task slots, the narrow work fused into the scan
stage (parsing, casting, scoring) would run on a few cores only, so such inputs are spread
round-robin first. Large inputs already have enough splits and are left alone, so there is
no extra shuffle at scale. Filters and column pruning are still pushed below the
repartition into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when ``df`` has fewer partitions than task slots."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def read_parquet(spark: SparkSession, path: str | list[str], schema=None, balance: bool = True) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return spread(df) if balance else df


def materialize(df: DataFrame, name: str = "table", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as parquet under the session's shared ``spark.checkpoint.dir`` and read it
    back: cuts lineage so plans that branch over it do not recompute its inputs, and the
    table survives executor loss. ``rows_per_file`` (0: no bound) ends a file early, so that few writers leave many splits."""
    import os
    import uuid
    from flowlens.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "flowlens", f"{name}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.parquet(path)
