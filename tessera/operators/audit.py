"""Comparison of two results, and slices of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s1, s23, change) of pairs (s1, s23) that only one of two results has."""
    on = ["s1", "s23"]
    return new.join(old, on, "left_anti").select(*on, F.lit("added").alias("change")).unionByName(old.join(new, on, "left_anti").select(*on, F.lit("removed").alias("change")))


def symmetric_tokens(pairs: DataFrame, a: str, b: str, n: int = 15) -> DataFrame:
    """The n most frequent sets of words that only one side of a pair has."""
    diff = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return pairs.select(F.array_join(diff, " ").alias("tokens")).where("tokens <> ''").groupBy("tokens").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tokens").limit(n)


def slices(rows: DataFrame) -> DataFrame:
    """(country, slice, n) of accepted pairs (with features and p) that deserve a look."""
    rows = rows.withColumn("__claims", F.count("*").over(Window.partitionBy("s23")))
    named = {
        "no_shared_number": "num_jacc = 0",
        "other_lead_number": "lead_eq = 0 and num_jacc > 0",
        "no_shared_name": "core_jacc = 0",
        "suffix_conflict": "sfx_compat = 3",
        "no_address": "b_addr_empty = 1",
        "contested": "__claims >= 2",
        "short_name": "sq_prefix < 4",
    }
    flags = F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in named.items()])
    return rows.select("country", F.explode(F.array_compact(flags)).alias("slice")).groupBy("country", "slice").agg(F.count("*").alias("n"))


def country_rates(rows: DataFrame, entities: DataFrame, flag: str) -> DataFrame:
    """(country, records, flagged, per_1000): flagged pairs a thousand records of source 1. ``rows``: country and the flag;
    ``entities``: country, one row a record."""
    bad = rows.groupBy("country").agg(F.sum(F.col(flag).cast("long")).alias("flagged"))
    n = entities.groupBy("country").agg(F.count("*").alias("records"))
    return n.join(bad, "country", "left").na.fill(0, ["flagged"]).withColumn("per_1000", 1000.0 * F.col("flagged") / F.col("records"))


def partition_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: pairs that giving each satellite one owner drops, and records that it leaves without any pair."""
    dropped = before.join(after, ["s1", "s23"], "left_anti").agg(F.count("*").alias("dropped"))
    emptied = before.select("s1").distinct().join(after, "s1", "left_anti").agg(F.count("*").alias("emptied"))
    return dropped.crossJoin(F.broadcast(emptied))  # one row each


def contested(rows: DataFrame) -> DataFrame:
    """``rows`` (s1, s23, lead_eq) with whether any pair of the record has an equal lead number, and whether several records
    claim the satellite."""
    return rows.withColumn("some_lead_eq", F.max("lead_eq").over(Window.partitionBy("s1"))).withColumn("contested", F.count("*").over(Window.partitionBy("s23")) >= 2)
