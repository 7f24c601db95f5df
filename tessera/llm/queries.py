"""The registered queries of this subpackage: production parameters, whole tables, whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, langid, linededup, mixing, ngramjoin, sql, topk, toxicity, urlfilter, warc
from tessera.session import materialize, read_table, scratch_path


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op2_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, toxicity.train(docs, labels.where(_remainder(3) != 1))).select("doc_id", "held_out", "score", "predicted", "spans")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.select("doc_id", "text", "lang").where(_remainder(5) != 0))
    rows = docs.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(True)).alias("held_out"), "text")
    return langid.identify(rows, profiles).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    first = materialize(warc.first_copies(pages), "copies")
    path = scratch_path(spark, "warc")
    warc.write(warc.records(pages, first), path)
    kind = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response")
    return warc.read(spark, path).select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("refers").cast("long").alias("refers_to"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).withColumn("n_removed", F.size("dropped"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_table(spark, sf_dir, "documents"))


#: Weight of a document by its quality label; unlabelled ones stand between.
QUALITY = {1: 2.0, 0: 0.5}


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality``: QUALITY by label (the best, if a document has several), else 1."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__q"))
    weight = F.when(F.col("__q") == 1, QUALITY[1]).when(F.col("__q") == 0, QUALITY[0]).otherwise(1.0)
    return docs.drop("quality").join(best, "doc_id", "left").withColumn("quality", weight).drop("__q")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_of(F.col("text")).alias("size"))
    rows = materialize(with_quality(docs, read_table(spark, sf_dir, "labels")), "sizes")
    return mixing.mix(rows, F.col("quality")).select("doc_id", "size", "source_size", "target", "taken")


def queries():
    return {
        "op1_topk": op1_topk,
        "op2_ngramjoin": op2_ngramjoin,
        "op3_bpe": op3_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_langid": op5_langid,
        "op6_warc": op6_warc,
        "op7_urlfilter": op7_urlfilter,
        "op8_linededup": op8_linededup,
        "op9_fingerprint": op9_fingerprint,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
