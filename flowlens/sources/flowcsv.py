"""Flow-CSV sources and sinks.

Fields stay text until B5. A line that can't be decoded has no array, and the width check rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.records import decode_lines
from flowlens.schemas import FLOW_COLUMNS_82


def _lines_to_csv(lines: DataFrame) -> DataFrame:
    placed = lines.select("value", F.col("_metadata.file_path").alias("source_file"))
    return decode_lines(placed, "value").select("csv", "source_file")


def read_flows_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A3: flow CSV files (82 or 80 columns) -> ``csv array<string>`` per line."""
    from flowlens.sources.io import spread
    return spread(_lines_to_csv(spark.read.text(path)))


def stream_flows_csv(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A4: new CSV files in a directory, each read from its start; the checkpoint replaces
    the file registry."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return _lines_to_csv(lines)


def write_flows_csv(flows: DataFrame, path: str, per_capture: str | None = None, columns: list[str] | None = None,
                    mode: str = "overwrite") -> None:
    """Flow records as CSV with a header line per output file; ``per_capture`` names a
    column giving one output directory per capture (separate mode), else one merged output."""
    columns = columns or FLOW_COLUMNS_82
    keep = [c for c in columns if c in flows.columns]
    out = flows.select(*(keep + ([per_capture] if per_capture else [])))
    w = out.write.mode(mode).option("header", True)
    if per_capture:
        w = w.partitionBy(per_capture)
    w.csv(path)


def write_scored_batch(batch: DataFrame, batch_id: int, path: str, date_col: str = "date") -> None:
    """One micro-batch of scored flows as parquet under ``batch_id=N`` partitioned by date: that of the flow's ``timestamp``
    if there is one, else of today. Overwriting the batch's own directory makes a replayed batch idempotent."""
    own = F.to_date(F.col("timestamp").try_cast("timestamp")) if "timestamp" in batch.columns else F.lit(None).cast("date")
    out = batch if date_col in batch.columns else batch.withColumn(date_col, F.coalesce(own, F.current_date()))
    out.write.mode("overwrite").partitionBy(date_col).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
