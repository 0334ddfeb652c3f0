"""The pipeline: each stage does its work on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, SF))
        assert kept.columns == columns, name
        counts.append(kept.count())
    low = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0")
    assert counts == sorted(counts, reverse=True) and counts[0] < docs.count() and counts[2] < counts[1] and counts[3] < counts[2]
    assert kept.join(low, "doc_id").count() < 0.1 * low.count()
    assert kept.groupBy(F.lower("text")).count().filter("count > 1").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert mixed.columns == columns and 0 < mixed.count() <= 3 * kept.count()
