"""Competition of pairs for a record: ranks, margins and sums within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_stats(df: DataFrame, group: str, value: str, tie: str, prefix: str) -> DataFrame:
    """Rank (from 1, largest first), margin to the best, sum, size and count above one half, per group."""
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc(value), tie)
    v = F.col(value)
    return df.withColumns(
        {
            f"{prefix}_rank": F.row_number().over(order),
            f"{prefix}_margin": F.max(v).over(whole) - v,
            f"{prefix}_sum": F.sum(v).over(whole),
            f"{prefix}_n": F.count("*").over(whole),
            f"{prefix}_above": F.sum((v > 0.5).cast("int")).over(whole),
        }
    )


def score_context(df: DataFrame, p: str = "p1") -> DataFrame:
    """What the second pass adds: the pair's place among its record's and its satellite's pairs."""
    out = group_stats(group_stats(df, "s1", p, "s23", "a"), "s23", p, "s1", "b")
    return out.select(*df.columns, F.col("a_rank").alias(f"{p}_rank"), F.col("a_margin").alias(f"{p}_margin"), F.col("a_sum").alias(f"{p}_sum"), F.col("a_above").alias(f"{p}_n_above"), F.col("b_rank").alias(f"{p}_rev_rank"), F.col("b_margin").alias(f"{p}_rev_margin"))


def owners(df: DataFrame, p: str = "p") -> DataFrame:
    """The best claimant of each satellite, ties to the lower s1."""
    order = Window.partitionBy("s23").orderBy(F.desc(p), "s1")
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
