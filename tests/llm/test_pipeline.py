"""The pipeline's stages: columns, whole results, and what each decision removes."""

import corpus_pipeline
from flowlens.llm import packing
from tests.conftest import SF001


def test_stages_filter_and_pack(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet").collect()
    toxic, clean = ({r["doc_id"] for r in labels if r["toxic"] == k} for k in (1, 0))    # others may be either
    seen = [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out, "test-stage")
        rows = docs.collect()
        seen.append({r["doc_id"] for r in rows})
        assert len(rows) == len(seen[-1]) and seen[-1] <= seen[-2], name
    assert len(seen[1] & toxic) <= 0.1 * len(toxic) and len(seen[1] & clean) >= 0.9 * len(seen[0] & clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).toPandas()
    assert set(packed.doc_id) == seen[-1] and (packed.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
