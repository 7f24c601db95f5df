"""Stages of the pipeline begin with the heap of earlier ones given back."""

import corpus_pipeline
from tessera import session


def _collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans)


def test_executors_collect_their_garbage(spark, monkeypatch):
    monkeypatch.setattr(session, "release", lambda *tables: None)  # the driver's own collection, in this JVM too
    before = _collections(spark)
    session.relieve(spark)
    assert _collections(spark) >= before + 2


def test_each_stage_begins_with_it(spark, monkeypatch):
    begun = []
    monkeypatch.setattr(corpus_pipeline, "relieve", begun.append)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(begun) == len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.tokenize(spark, docs, "/root/testdata/sf0.001").count() == docs.count()
