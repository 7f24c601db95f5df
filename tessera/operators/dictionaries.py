"""Dictionaries mined from the records: legal forms, abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import subsequence

MIN_SHARE, MIN_LAST, MIN_PREDECESSORS, MIN_COUNT = 0.003, 0.9, 50, 20


def legal_loose(signed: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(token): frequent last words of a country's names, and both words of a frequent last pair whose second is one;
    numbers and words of more than 12 characters left out."""
    names = signed.where(F.size("words") > 0).select("country", F.element_at("words", -1).alias("last"), F.when(F.size("words") >= 2, F.element_at("words", -2)).alias("before"))
    n = signed.groupBy("country").agg(F.count("*").alias("n"))
    single = names.groupBy("country", "last").agg(F.count("*").alias("v")).join(n, "country").where(F.col("v") / F.col("n") >= min_share).select(F.col("last").alias("token")).distinct()
    double = names.where("before is not null").groupBy("country", "before", "last").agg(F.count("*").alias("v")).join(n, "country").where(F.col("v") / F.col("n") >= min_share)
    firsts = double.join(single.withColumnRenamed("token", "last"), "last", "left_semi").select(F.col("before").alias("token"))
    return single.unionByName(firsts).distinct().where(~F.col("token").rlike("^[0-9]+$") & (F.length("token") <= 12))


def legal_strict(signed: DataFrame, min_share: float = MIN_SHARE, min_last: float = MIN_LAST, min_predecessors: int = MIN_PREDECESSORS) -> DataFrame:
    """(country, token): frequent last words that are rarely elsewhere and follow many different words."""
    n = signed.groupBy("country").agg(F.count("*").alias("n"))
    last = signed.where(F.size("words") > 0).groupBy("country", F.element_at("words", -1).alias("token")).agg(F.count("*").alias("v"), F.countDistinct(F.when(F.size("words") >= 2, F.element_at("words", -2))).alias("preds"))
    anywhere = signed.select("country", F.explode(F.array_distinct("words")).alias("token")).groupBy("country", "token").agg(F.count("*").alias("places"))
    met = last.join(n, "country").join(anywhere, ["country", "token"])
    return met.where((F.col("v") / F.col("n") >= min_share) & (F.col("v") / F.col("places") >= min_last) & (F.col("preds") >= min_predecessors)).where(~F.col("token").rlike("^[0-9]+$") & (F.length("token") <= 12)).select("country", "token")


def pseudo_pairs(signed: DataFrame, least: int = 8) -> DataFrame:
    """(a, b): word lists of addresses of records that share a long squashed name and the first number, where the name and
    number occur once in source 1: matches that need no labels."""
    keyed = signed.where((F.length("squash") >= least) & (F.size("nums") > 0)).select("country", "squash", F.element_at("nums", 1).alias("num"), "src", "addr")
    on = ["country", "squash", "num"]
    once = keyed.where("src = 1").groupBy(*on).agg(F.count("*").alias("n"), F.first("addr").alias("a")).where("n = 1").drop("n")
    return once.join(keyed.where("src <> 1").select(*on, F.col("addr").alias("b")), on).select("a", "b")


def abbreviations(pairs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(short, long, n): of address pairs (a, b: word lists), unmatched short words (two to four letters) that can be read off
    an unmatched word, or two neighbours, of the other side. A short word's most frequent long form stays if it is frequent
    and explains at least half of the short word's occurrences."""
    alpha = lambda x: F.filter(x, lambda w: w.rlike("^[a-z]+$"))

    def longs(own, only):
        joined = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda i: F.array_contains(only, F.get(own, i - 1)) & F.array_contains(only, F.get(own, i))), lambda i: F.concat(F.get(own, i - 1), F.get(own, i)))
        return F.array_union(only, F.filter(joined, lambda x: x.isNotNull()))

    rows = pairs.select(alpha(F.col("a")).alias("a"), alpha(F.col("b")).alias("b")).withColumns({"ua": F.array_except("a", "b"), "ub": F.array_except("b", "a")})
    sides = rows.select(F.explode(F.array(F.struct(F.col("ua").alias("s"), longs(F.col("b"), F.col("ub")).alias("l")), F.struct(F.col("ub").alias("s"), longs(F.col("a"), F.col("ua")).alias("l")))).alias("x"))
    shorts = sides.select(F.explode("x.s").alias("short"), F.col("x.l").alias("l")).where(F.length("short").between(2, 4))
    totals = shorts.groupBy("short").agg(F.count("*").alias("total"))
    met = shorts.select("short", F.explode("l").alias("long")).where((F.length("long") >= F.length("short") + 2) & subsequence(F.col("short"), F.col("long")))
    counts = met.groupBy("short", "long").agg(F.count("*").alias("n")).join(totals, "short").where((F.col("n") >= min_count) & (F.col("n") >= 0.5 * F.col("total")))
    best = Window.partitionBy("short").orderBy(F.desc("n"), "long")
    return counts.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("short", "long", "n")
