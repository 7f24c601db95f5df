"""Lookups, samples and rankings that choose rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join in which every key of ``rows`` must be found; raises ValueError with one that isn't."""
    missing = rows.join(table, on, "left_anti").select(on).take(1)
    if missing:
        raise ValueError(f"{on} {missing[0][0]!r} is not in the table")
    return rows.join(table, on)


def aligned(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join of two tables that must hold the same keys, once each; raises ValueError else. Row order plays no part."""
    sides = left.select(*on, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*on, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    odd = sides.groupBy(*on).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r")).where("l <> 1 or r <> 1").take(1)
    if odd:
        raise ValueError(f"tables differ at {odd[0].asDict()}")
    return left.join(right, on)


def without_match(entities: DataFrame, matches: DataFrame) -> DataFrame:
    return entities.join(matches, "s1", "left_anti")


def best_per_entity(pairs: DataFrame, score: str = "p", tie: str = "s23") -> DataFrame:
    """Each record's best pair; ties go to the smaller partner."""
    order = Window.partitionBy("s1").orderBy(F.desc(score), tie)
    return pairs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def hard_negatives(pairs: DataFrame, most: int = 3, score: str = "prescore", label: str = "label") -> DataFrame:
    """The best scored pairs of each record that are no matches."""
    order = Window.partitionBy("s1").orderBy(F.desc(score), "s23")
    return pairs.where(F.col(label) == 0).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def drawn(key: Column, seed: int = 42) -> Column:
    """A number for each whole-number key and seed, the same in every engine; its order is the order of a seeded draw."""
    return F.pmod(key.cast("bigint") * 2654435761 + seed * 40503, F.lit(1_000_003))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones in every run."""
    return rows.orderBy(drawn(F.col(key), seed), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows with ``place``, from 1, in a seeded order within each ``country``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(drawn(F.col(key), seed), key)))


def random_pairs(left: DataFrame, right: DataFrame, seed: int = 42) -> DataFrame:
    """(s1, s23): each record of ``left`` (entity_id, country) with one of ``right`` in its country, drawn with replacement:
    the records of a country are numbered in one order, and each draws a number."""
    numbered = right.select("country", F.col("entity_id").alias("s23"), F.row_number().over(Window.partitionBy("country").orderBy("entity_id")).alias("at"))
    n = right.groupBy("country").agg(F.count("*").alias("n"))
    drew = left.join(n, "country").select("country", F.col("entity_id").alias("s1"), (F.pmod(drawn(F.col("entity_id"), seed), F.col("n")) + 1).alias("at"))
    return drew.join(numbered, ["country", "at"]).select("s1", "s23")


def unseen(rows: DataFrame, known: DataFrame, column: str = "country") -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column).distinct(), column, "left_anti")


def vocabulary_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``words`` (country, word, ...) with ``n`` of the vocabulary (country, word, n), 0 for unknown ones."""
    return words.join(vocabulary, ["country", "word"], "left").na.fill(0, ["n"])
