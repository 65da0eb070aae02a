"""A corpus pipeline over `documents`: toxicity, language ID, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared
checkpoint folder, and the next stage reads it from there. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import langid, neardup, packing, toxicity
from flowlens.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", langid.stage),
    ("near_duplicates", neardup.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained classifiers and signatures cannot be said in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"stage-{name}")
    return out
