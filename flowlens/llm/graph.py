"""Connected components of a large graph by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (id, component) for every id that has an edge; component is the smallest id reachable.

    Every round is a few hash aggregations and joins, and its edges are written to the shared checkpoint
    folder. A vertex with a third of all edges is pre-aggregated before each shuffle; nothing is collected.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large star: each vertex links its larger neighbours to the smallest of its neighbourhood
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each vertex links its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct(), "cc")
    ids = now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return ids.unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
