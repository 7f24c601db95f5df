"""Rows that can't meet leave before a shuffle, and no other."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import ngramjoin, skew


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_sifted_rows_hold_all_that_meet(spark, n):
    key = F.xxhash64("id")
    rows = spark.range(40_000).withColumns({"key": F.when(F.col("id") != 39_999, key), "more": F.array("id")})
    told = spark.range(n).select(key.alias("own"))
    kept = skew.sifted(rows, F.col("key"), told, F.col("own"), n)
    assert kept.columns == rows.columns
    ids = {r.id for r in kept.select("id").collect()}
    assert ids >= set(range(n)) and 39_999 not in ids
    assert len(ids) - n <= (40_000 - n) / 12


def test_sifted_beyond_its_largest_bitmap_keeps_all_that_meet(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_BITS", 15)
    told = spark.range(20_000).select(F.xxhash64("id").alias("own"))
    kept = skew.sifted(spark.range(40_000).withColumn("key", F.xxhash64("id")), F.col("key"), told, F.col("own"), 20_000)
    assert kept.where("id < 20000").count() == 20_000


def test_texts_that_meet_none_are_not_dealt_out(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(2000)]
    rows += [(i + 2000, rows[i][1] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []
    own = ngramjoin.sifted

    def counted(rows, key, told, told_key, n):
        out = own(rows, key, told, told_key, n)
        dealt.append(out.count() if "text" in rows.columns else -1)
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngramjoin, "sifted", counted)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(docs).collect()}
    assert 20 <= max(dealt) <= 200
    assert got == {i: (i - 2000 if i >= 2000 else i, 1 if i < 10 or i >= 2000 else 0) for i in range(2010)}
