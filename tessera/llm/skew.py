"""Joins whose hot keys are dealt to many tasks, rows that can't meet left out before a shuffle, and bounded samples without a
hot task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key of more than one part in SHARE of all rows is hot: there are fewer than SHARE of them, whatever the data. Its rows go to SALTS places.
SHARE, SALTS = 512, 64
#: ``sifted`` takes 16 to 32 bits a key, and so many (as powers of two) at least and at most: 16 MB.
LEAST_BITS, MOST_BITS = 15, 27


def spread_join(rows: DataFrame, told: DataFrame, on: list[str], weight: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``told``, which has one row a key (or a few) and says in ``weight`` how many of the
    ``total`` rows have it. Rows of hot keys are told apart by a hash of ``by``, the hot keys' rows of ``told`` repeated; the
    list of hot keys is broadcast, as its length is bounded: under SHARE. Null keys meet nothing."""
    hot = F.col(weight) > max(total // SHARE, 64)
    listed = told.where(hot).select(*on).distinct().withColumn("__hot", F.lit(True))
    left = rows.join(F.broadcast(listed), on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    right = told.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def sifted(rows: DataFrame, key: Column, told: DataFrame, told_key: Column, n: int) -> DataFrame:
    """Rows of ``rows`` whose ``key`` (a 64-bit hash) may be among the ``n`` ones of ``told``: all that are, and of the others
    up to one in 16, or more where ``told`` has above 8 million keys. For joins that few rows outlive, before their shuffle. Keys
    are marked in a bitmap that is broadcast and never larger than ``MOST_BITS`` allow, whatever the data."""
    power = min(max(math.ceil(math.log2(16 * max(n, 1))), LEAST_BITS), MOST_BITS)
    place = lambda k: F.pmod(k, F.lit(1 << power))
    page = lambda k: F.shiftright(place(k), 15).cast("int").alias("__page")
    bit = lambda k: F.pmod(place(k), F.lit(1 << 15))
    marks = told.select(page(told_key), bit(told_key).alias("__bit")).repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    met = rows.withColumns({"__page": page(key), "__bit": bit(key).cast("int")}).join(F.broadcast(marks), "__page")
    byte = F.expr("cast(conv(hex(substring(__map, __bit div 8 + 1, 1)), 16, 10) as int)")
    return met.where(F.getbit(byte, F.pmod("__bit", F.lit(8))) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def least_hashed(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(group, key), distinct: the ``most`` keys of least hash of each group. Groups are few (labels, languages) and their row
    counts come to the driver; from these follows a bound of the hash that leaves a little more than ``most`` rows a group
    to be ranked, so no task ranks a whole group. Where keys repeat in a group, fewer may come out."""
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).collect()}
    if not counts:
        return rows.select(group, key).where(F.lit(False))
    room = most + 8 * math.sqrt(most) + 8
    bound = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, room / n)))])
    draw = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(2**53))
    few = rows.select(group, key).where(draw < F.element_at(bound, F.col(group))).distinct()
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return few.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
