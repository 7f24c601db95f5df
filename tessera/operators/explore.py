"""Counts and rates that describe records, links and scored pairs before and after linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def mix(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., n, share): how the rows spread over the values of some columns."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(every)).select(*by, "n", (F.col("n") / F.col("__all")).alias("share"))  # one row


def match_counts(entities: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(n2, n3, entities): how many records of source 1 have n2 matches in source 2 and n3 in source 3; those without any
    count as well. ``links``: s1, s23; ``sources``: s23, src."""
    of = lambda k: F.sum((F.col("src") == k).cast("long"))
    found = links.join(sources, "s23").groupBy("s1").agg(of(2).alias("n2"), of(3).alias("n3"))
    return entities.join(found, "s1", "left").na.fill(0, ["n2", "n3"]).groupBy("n2", "n3").agg(F.count("*").alias("entities"))


def partition_check(links: DataFrame) -> DataFrame:
    """One row: links, satellites among them, and links beyond one a satellite (0 if no satellite has two owners)."""
    return links.agg(F.count("*").alias("links"), F.countDistinct("s23").alias("satellites")).withColumn("shared", F.col("links") - F.col("satellites"))


def quality_flags(text: Column) -> dict[str, Column]:
    """What a raw field looks like; false for null."""
    some = F.coalesce(text, F.lit(""))
    letters = F.regexp_replace(some, "[^A-Za-z]+", "")
    return {
        "empty": F.trim(some) == "",
        "non_ascii": some.rlike(r"[^\x00-\x7F]"),
        "domain": T.is_domain(some),
        "junk_prefix": some.rlike(r"^\s*[^0-9A-Za-z\s]"),
        "brackets": some.rlike(r"[\[\](){}]"),
        "starts_with_number": some.rlike(r"^\s*[0-9]"),
        "all_caps": (letters != "") & (letters == F.upper(letters)),
    }


def field_quality(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """(by..., n, share of each flag, mean_length) of a raw field."""
    flags = quality_flags(F.col(text))
    told = [F.avg(c.cast("double")).alias(name) for name, c in flags.items()]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *told, F.avg(F.length(F.coalesce(F.col(text), F.lit(""))).cast("double")).alias("mean_length"))


def key_recall(emitted: DataFrame, truth: DataFrame, groups: dict[str, int]) -> DataFrame:
    """(keys, recall): share of true pairs that meet under any key of each group of bits, blocks of any size. Counted on the
    true pairs alone: keys of both records meet in a join on the record."""
    held = emitted.groupBy("entity_id").agg(F.collect_set(F.struct("bit", "key")).alias("k"))  # a few dozen a record
    a, b = held.select(F.col("entity_id").alias("s1"), F.col("k").alias("__a")), held.select(F.col("entity_id").alias("s23"), F.col("k").alias("__b"))
    met = truth.join(a, "s1", "left").join(b, "s23", "left").withColumn("__k", F.coalesce(F.array_intersect("__a", "__b"), F.array().cast("array<struct<bit:int,key:string>>")))
    some = lambda bits: F.exists("__k", lambda x: x["bit"].bitwiseAND(bits) > 0)
    row = met.agg(*[F.avg(some(bits).cast("double")).alias(name) for name, bits in groups.items()])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*[F.col(f"`{g}`") for g in groups])))).toDF("keys", "recall")


def ranking_quality(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: n, positives, area under the ROC curve (ties count half) and average precision (ties at their end). Scores are
    counted first, so the windows run over distinct scores only, which are few for calibrated ones."""
    hit = (F.col(label) == 1).cast("long")
    counts = rows.groupBy(F.col(score).alias("p")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    up = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = counts.select("*", F.coalesce(F.sum("neg").over(up), F.lit(0)).alias("below"), F.sum("pos").over(down).alias("tp"), F.sum(F.col("pos") + F.col("neg")).over(down).alias("taken"))
    told = seen.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), F.sum("neg").alias("__neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("__pairs"), F.sum(F.col("pos") * F.col("tp") / F.col("taken")).alias("__precise"))
    return told.select("n", "positives", F.try_divide(F.col("__pairs"), F.col("positives") * F.col("__neg")).alias("auc"), F.try_divide(F.col("__precise"), F.col("positives")).alias("average_precision"))


def grey_accuracy(rows: DataFrame, score: str = "p", label: str = "label", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: pairs in the grey zone (both ends in), and the share whose side of one half is their label."""
    grey = rows.where(F.col(score).between(low, high))
    return grey.agg(F.count("*").alias("n"), F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def record_text(name: Column, address: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" ; "), F.coalesce(address, F.lit("")))


def pair_text(country: Column, a: Column, b: Column) -> Column:
    """What a pair scorer reads."""
    return F.concat(country, F.lit("\nA: "), a, F.lit("\nB: "), b)


def lead_number(words: Column) -> Column:
    """The first number as a whole number, -1 without one; numbers too long for 18 digits count as none."""
    first = F.get(words, 0)
    return F.when(F.length(first) <= 18, first.cast("long")).otherwise(F.lit(-1).cast("long"))
