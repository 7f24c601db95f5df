"""Entity-level scores and blocking diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {f"k{i + 1}": 1 << i for i in range(7)}


def entity_f05(pred: DataFrame, truth: DataFrame, entities: DataFrame, by: list[str] | None = None, grid: DataFrame | None = None) -> DataFrame:
    """(by..., s1, f05) of every entity: 1.25 tp / (0.25 true + predicted); without truth 1 if nothing is predicted, else 0."""
    by = by or []
    n_pred = pred.groupBy(*by, "s1").agg(F.count("*").alias("n_pred"))
    tp = pred.join(truth.select("s1", "s23").distinct(), ["s1", "s23"]).groupBy(*by, "s1").agg(F.count("*").alias("tp"))
    n_true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    every = entities.select("s1")
    if grid is not None:
        every = every.crossJoin(F.broadcast(grid))  # the grid is a parameter, not data
    rows = every.join(n_pred, [*by, "s1"], "left").join(tp, [*by, "s1"], "left").join(n_true, "s1", "left").na.fill(0, ["n_pred", "tp", "n_true"])
    f = F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("n_pred")))
    return rows.select(*by, "s1", f.alias("f05"))


def macro_f05(pred: DataFrame, truth: DataFrame, entities: DataFrame, by: list[str] | None = None, grid: DataFrame | None = None) -> DataFrame:
    return entity_f05(pred, truth, entities, by, grid).groupBy(*(by or [])).agg(F.avg("f05").alias("macro_f05"))


def best_setting(swept: DataFrame) -> DataFrame:
    """The best row of a sweep: by score to four places (half to even), then by mode, then by the score itself."""
    order = F.when(F.col("mode") == "partition", 0).when(F.col("mode") == "threshold", 1).otherwise(2)
    return swept.orderBy(F.bround("macro_f05", 4).desc(), order, F.desc("macro_f05"), "tau").limit(1)


def blocking_report(candidates: DataFrame, truth: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """One row: pair completeness, reduction ratio, share of true pairs and, per key, recall and what only that key finds."""
    seen = truth.join(candidates, ["s1", "s23"], "left").withColumn("bits", F.coalesce("kbits", F.lit(0)))
    told = [F.avg((F.col("bits") > 0).cast("double")).alias("pair_completeness")]
    for name, bit in KEYS.items():
        told += [F.avg((F.col("bits").bitwiseAND(bit) > 0).cast("double")).alias(f"{name}_recall"), F.avg((F.col("bits") == bit).cast("double")).alias(f"{name}_only")]
    n = candidates.agg(F.count("*").alias("n_candidates"))
    return seen.agg(*told, F.sum((F.col("bits") > 0).cast("long")).alias("found")).crossJoin(F.broadcast(n)).withColumn("reduction_ratio", 1 - F.col("n_candidates") / float(max(n_left * n_right, 1)))  # one row each


def per_entity(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates an entity: mean, 95th percentile, largest, share of entities without any."""
    n = entities.join(candidates.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0, ["n"])
    return n.agg(F.avg("n").alias("mean"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("largest"), F.avg((F.col("n") == 0).cast("double")).alias("zero_share"))
