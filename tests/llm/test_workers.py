"""A task of the pipeline has one Python worker, and that keeps nothing of the operator before."""

import public_tokenizers as P

import corpus_pipeline
from tessera.llm import bpe, ngramjoin, worker

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def _workers(df):
    """Of a task, for Python on single columns."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_languages_are_told_once_a_text(spark):
    assert _workers(corpus_pipeline.identify_language(spark, spark.read.parquet(DOCUMENTS), "")) == 1


def test_texts_that_meet_another_are_cut_once(spark, monkeypatch):
    made = {}

    def seen(df, label, write=ngramjoin.materialize):
        made[label] = _workers(df)
        return write(df, label)

    monkeypatch.setattr(ngramjoin, "materialize", seen)
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "something else")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert made["signatures"] == made["links"] == 1


def test_another_operator_drops_the_codec():
    told = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode("some words")
    worker.use("bpe", bpe.forget)
    worker.use("langid")
    assert not bpe._codecs
    assert bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode("some words") == told
