"""The registered queries and stages on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark):
    import corpus_pipeline as pipeline
    from tessera.llm.scratch import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "pack_sequences":
            assert docs.columns == pipeline.COLUMNS
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert docs.agg({"offset": "max"}).first()[0] < 4096


def test_stages_on_nothing(spark):
    import corpus_pipeline as pipeline
    from tessera.llm.scratch import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0
