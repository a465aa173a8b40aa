"""The pipeline on the smallest tables: each stage narrows what the one before has left."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert docs.dtypes == before.dtypes, name
        assert 0 < docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").isEmpty()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.where("text <> ''").select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_short_clean_documents_stay(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    short = {r[0] for r in docs.where(r"regexp_count(text, '[^ \\t-\\r]+') BETWEEN 1 AND 4").join(good, "doc_id", "left_semi").select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
    assert short and short <= {r[0] for r in docs.select("doc_id").collect()}
