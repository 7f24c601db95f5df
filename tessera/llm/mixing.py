"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight, E / w; in ascending order of the keys a source's
documents are a weighted sample without replacement. A source whose target is k times its size and a rest gives k whole
epochs first; then documents in key order until the rest is met. The order is not sorted as a whole: keys fall into
buckets, the prefix sums of the buckets tell in which one the budget ends, and only the documents of that bucket are
ranked. So a source that holds a third of all rows is as spread out as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most times that a source's documents are taken; buckets of keys for each source.
MOST_EPOCHS, BUCKETS = 3, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of the key: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: Column, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``target``: shares of the whole by weight, none above ``most``
    times its size, the excess reshared by weight. In ascending order of cap over weight the capped ones come first, and
    the level of the others is what is left over their weights."""
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("weight", weights).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0))
    rows = rows.withColumn("level", left / weight_left).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everything)  # rises over the capped ones, falls after
    return rows.withColumn("target", F.round(F.when(F.col("open"), F.col("weight") * level).otherwise(F.col("cap")), 6)).drop("weight", "cap", "level", "open")


def by_position(order: Column) -> Column:
    """1, 2, 3, repeating, by code point order of the sources, null last."""
    return (F.row_number().over(Window.orderBy(order.asc_nulls_last())) - 1) % 3 + 1


def mix(docs: DataFrame, quality: Column | None = None, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = "mix", weights: Column | None = None) -> DataFrame:
    """``docs`` (key, source, size in words, any more columns) with ``source_size``, ``target`` and ``taken``: words taken
    of the document, repeats counted. ``quality`` is a positive weight, 1 if null. A document is taken whole; the one
    across which the budget ends is taken if more than half of it fits. Null sources are one source. Empty documents take
    nothing; repeated rows draw the same key and are ranked one after the other."""
    made = ("source_size", "target", "taken")
    quality = F.greatest(F.coalesce(quality, F.lit(1.0)).cast("double"), F.lit(1e-9)) if quality is not None else F.lit(1.0)
    docs = docs.drop(*made)
    drawn = -F.log(uniform(F.col(key), seed)) / quality
    rows = docs.withColumn("__key", drawn).withColumn("__bucket", F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("__key")))).cast("int"))
    buckets = rows.groupBy(F.col(source).alias("source"), "__bucket").agg(F.sum(size).alias("__words"))
    sizes = buckets.groupBy("source").agg(F.sum("__words").alias("source_size"))
    aimed = targets(sizes, weights if weights is not None else by_position(F.col("source")))
    aimed = aimed.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aimed = aimed.withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = _same(buckets.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0))), aimed)
    plan = plan.withColumn("__part", F.when(F.col("__before") + F.col("__words") <= F.col("__rest"), 1).when(F.col("__before") >= F.col("__rest"), 0))
    plan = plan.select(F.col("source").alias("__source"), F.col("__bucket").alias("__b"), "source_size", "target", "__epochs", "__rest", "__before", "__part")
    met = rows.join(plan, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    whole = met.where("__part is not null").withColumn("__take", F.col("__part"))
    inside = Window.partitionBy("__source").orderBy("__key", F.col(key).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = met.where("__part is null").withColumn("__upto", F.col("__before") + F.sum(size).over(inside))
    edge = edge.withColumn("__take", (F.col("__upto") - F.col(size) / 2 < F.col("__rest")).cast("int")).drop("__upto")
    out = whole.unionByName(edge).withColumn("taken", (F.col(size) * (F.col("__epochs") + F.col("__take"))).cast("long"))
    return out.select(*docs.columns, *made)


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "__right")
    return left.join(right, F.col("source").eqNullSafe(F.col("__right"))).drop("__right")
