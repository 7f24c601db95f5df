"""From raw documents to a token corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, linededup, mixing, ngramjoin
from tessera.llm.queries import with_quality
from tessera.session import materialize, read_table, relieve


def _relieved(stage):
    """A stage that finds the heap of the ones before it given back: together they would outgrow an executor."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieve(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_relieved
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages go: those without a letter, and those that are as far from
    every profile as unrelated letters are. The profiles are learned from the stage's own input. A document without a language
    gets the predicted one."""
    told = langid.identify(docs, langid.learn_profiles(docs))
    kept = told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > langid.REJECT_AT))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@_relieved
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, exactly or nearly, go; so do documents that lose all their words with them."""
    kept = linededup.dedup(docs).where((F.size("dropped") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_relieved
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the document of least id, the one of least row key. Rows are told apart
    by id and text, so of an id with two texts one may go; of rows that repeat both one stays."""
    told = materialize(ngramjoin.join_rows(docs).select("uid", (F.col("uid") != F.col("class_uid")).alias("copy")), "classes")
    again = materialize(told.where("not copy").groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid"), "repeated")
    gone = materialize(told.where("copy").select("uid").unionByName(again).distinct(), "copies")
    rows = docs.withColumn("uid", ngramjoin.row_key())
    once = rows.join(again, "uid", "left_semi").dropDuplicates(["uid"])
    return rows.join(gone, "uid", "left_anti").unionByName(once.select(*rows.columns)).select(*docs.columns)


@_relieved
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: a document comes out as often as the mix takes it, none at all if it doesn't.
    Rows that repeat a document share its decision."""
    uid = F.xxhash64("doc_id", "text")
    narrow = docs.select("doc_id", "source", uid.alias("__uid"), mixing.words_of(F.col("text")).alias("size")).where("size > 0")
    rows = materialize(with_quality(narrow, read_table(spark, sf_dir, "labels")), "sizes")
    mixed = mixing.mix(rows, F.col("quality")).select(F.col("doc_id").alias("__id"), "__uid", F.expr("int(taken div size)").alias("__times"))
    times = mixed.where("__times > 0").groupBy("__id", "__uid").agg(F.max("__times").alias("__times"))
    met = docs.withColumn("__own", uid).join(times, (F.col("__own") == F.col("__uid")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


@_relieved
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: MinHash, profiles and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
