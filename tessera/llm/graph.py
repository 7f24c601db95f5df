"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import spread_join
from tessera.session import discard, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"), F.count("*").alias("__n")).select("src", F.least("src", "least").alias("least"), "__n")
    return spread_join(both.where("dst > src"), least, ["src"], "__n", 2 * n, ["dst"]).select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    met = down.join(least, "src")  # a node's edges to lesser ones: one each after a large star, but for the first rounds
    return met.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst of one orderable type) -> (node, component): the least node of each node's component. Loops,
    repeated edges and nulls are harmless; nodes without an edge to another node don't come out. Every round is a table
    in the shared folder; a hub's edges meet only in aggregations, which combine before the shuffle, and in a join that deals
    them to many tasks."""
    now = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    mark = (now.count(), None)
    while True:
        step = materialize(_small_star(_large_star(now, mark[0]).distinct()).distinct(), "edges")
        new = step.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
        discard(now)
        now = step
        if tuple(new) == mark or new[0] == 0:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        mark = tuple(new)
