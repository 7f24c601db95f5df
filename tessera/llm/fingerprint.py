"""Document fingerprints as invertible Bloom lookup tables, in DataFrame operations only.

A text's paragraphs (lines; a longer one in pieces of PIECE characters) are hashed, a repeated one with its count, so that
they form a set. Each digest goes to one cell in each of three subtables; a cell holds a count and the exclusive or of its
digests and of their check hashes. Tables of one size subtract cell by cell, what two texts share cancels, and peeling
recovers the digests that only one has: a cell that holds exactly one gives it away, which frees others. If cells remain,
both tables are made anew with more cells.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 512
#: Cells of a subtable at least, and at most.
LEAST, MOST = 8, 1 << 24
#: Peeling rounds of an attempt; cells of the attempts after the first, times the digests of both texts. Attempts fail where
#: digests share their cells in all three subtables: of two digests in 8 cells one pair in 512 does, at the last attempt none in 2^39.
ROUNDS, LARGER = 16, (1, 4, 4096)
#: Characters of a range of documents, on average; ranges at most.
RANGE_CHARS, RANGES = 1 << 24, 1 << 16


def keys_of(text: Column) -> Column:
    """Sorted array of the digests of a text's paragraphs, the n-th copy of one told from the first."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0))
    ordered = F.sort_array(F.transform(pieces, lambda x: F.xxhash64(x)))

    def first(a: Column, x: Column) -> Column:
        """Where x first stands in the sorted array, from 0, by halving."""
        half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(a, half(s)) < x, F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a).cast("double") + 1)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(a).alias("hi")), step, lambda s: s["lo"])

    alone = lambda a: F.transform(a, lambda x: F.xxhash64(x, F.lit(0).cast("long")))
    told = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, (i - first(a, x)).cast("long")))
    return _let(ordered, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), alone(a)).otherwise(told(a)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def _cell(key: Column, sub: Column, m: Column) -> Column:
    slice_ = F.when(sub == 0, key).when(sub == 1, F.shiftrightunsigned(key, 20)).otherwise(F.shiftrightunsigned(key, 40))
    return slice_.bitwiseAND(m - 1)


def cells_for(n: Column) -> Column:
    """Cells of a subtable for n digests: the power of two from n on, within bounds. So the difference of two unrelated texts
    of about that many paragraphs still peels."""
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long"), F.lit(LEAST).cast("long")), F.lit(MOST).cast("long"))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def _group(m: Column) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(m.cast("double")) / 2)).cast("long")


def table(keys: Column, m: Column) -> Column:
    """3 m cells. Digests are first split into groups of cells, so that the work grows as n times the root of m."""
    group = _group(m)
    add = lambda s, x: F.struct((s["c"] + 1).alias("c"), s["k"].bitwiseXOR(x).alias("k"), s["h"].bitwiseXOR(_check(x)).alias("h"))

    def sub(t: int) -> Column:
        def cells(g: Column, own: Column) -> Column:
            return F.transform(F.sequence(g * group, (g + 1) * group - 1), lambda c: F.aggregate(F.filter(own, lambda x: _cell(x, F.lit(t), m) == c), _zero(), add))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(m / group) - 1), lambda g: _let(F.filter(keys, lambda x: F.floor(_cell(x, F.lit(t), m) / group) == g), lambda own: cells(g, own))))

    return F.concat(sub(0), sub(1), sub(2))


def difference(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: F.struct((a["c"] - b["c"]).alias("c"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h")))


def peel(cells: Column, m: Column) -> Column:
    """(left: cells that could not be emptied, first: digests of the first table alone, second: of the second alone)."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("first"), none.alias("second"), F.lit(False).alias("done"))

    def round_(s: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(s["cells"], lambda c: (F.abs(c["c"]) == 1) & (c["h"] == _check(c["k"]))), lambda c: F.struct(c["k"].alias("k"), c["c"].alias("c"))))

        def remove(found: Column) -> Column:
            take = lambda a, p: F.struct((a["c"] - p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(_check(p["k"])).alias("h"))
            group = _group(m)
            many = F.floor(m / group)
            mine = lambda own, q, i: F.filter(own, lambda p: _cell(p["k"], F.floor(q / many), m) == F.pmod(q, many) * group + i)
            part = lambda q, own: F.transform(F.slice(s["cells"], (q * group + 1).cast("int"), group.cast("int")), lambda c, i: F.when((c["c"] == 0) & (c["k"] == 0), c).otherwise(F.aggregate(mine(own, q, i), c, take)))
            near = lambda q: F.filter(found, lambda p: F.floor(_cell(p["k"], F.floor(q / many), m) / group) == F.pmod(q, many))
            left = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), many * 3 - 1), lambda q: _let(near(q), lambda own: part(q, own))))
            of = lambda sign: F.transform(F.filter(found, lambda p: p["c"] == sign), lambda p: p["k"])
            return F.when(F.size(found) == 0, F.struct(s["cells"].alias("cells"), s["first"].alias("first"), s["second"].alias("second"), F.lit(True).alias("done"))).otherwise(
                F.struct(left.alias("cells"), F.concat(s["first"], of(1)).alias("first"), F.concat(s["second"], of(-1)).alias("second"), F.lit(False).alias("done"))
            )

        return F.when(s["done"], s).otherwise(_let(pure, remove))

    end = lambda s: F.struct(F.size(F.filter(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0))).alias("left"), s["first"].alias("first"), s["second"].alias("second"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, end)


def with_comparison(rows: DataFrame, one: str, other: str, out: str, cells: str, m: str) -> DataFrame:
    """``rows`` with ``out``, what peeling the difference of two texts' tables recovers, as ``peel`` gives it. ``one`` and
    ``other`` name their keys; ``cells`` and ``m`` the first text's own table, which the first attempt takes. Each further
    attempt is a projection of its own that makes both tables anew, larger, where the last has left cells; of the last
    attempt ``left`` may stay above 0."""
    a, b = F.col(one), F.col(other)
    rows = rows.withColumn("__there", table(b, F.col(m)))
    rows = rows.withColumn("__diff", difference(F.col(cells), F.col("__there"))).withColumn(out, peel(F.col("__diff"), F.col(m)))
    for times in LARGER:
        failed = F.col(f"{out}.left") > 0
        room = F.greatest(F.col(m), cells_for((F.size(a) + F.size(b)).cast("double"))) * times
        rows = rows.withColumn("__m", F.least(room, F.lit(MOST).cast("long")))
        rows = rows.withColumn("__here", F.when(failed, table(a, F.col("__m")))).withColumn("__there", F.when(failed, table(b, F.col("__m"))))
        rows = rows.withColumn("__diff", difference(F.col("__here"), F.col("__there")))
        rows = rows.withColumn(out, F.when(failed, peel(F.col("__diff"), F.col("__m"))).otherwise(F.col(out)))
    return rows.drop("__here", "__there", "__diff", "__m")


def likeness(cells: Column, m: Column, found: Column) -> Column:
    """Share of the paragraphs of either text that both have; 1 for two empty texts. How many the first has is the sum of
    the counts in a subtable; what only one has is what peeling recovered."""
    own = F.aggregate(F.slice(cells, F.lit(1), m.cast("int")), F.lit(0), lambda s, c: s + c["c"])
    both = own - F.size(found["first"])
    every = both + F.size(found["first"]) + F.size(found["second"])
    return F.when(every == 0, 1.0).otherwise(F.least(F.greatest(both / every, F.lit(0.0)), F.lit(1.0)))


def as_text(cells: Column, m: Column) -> Column:
    """m and the cells that aren't empty, each as number:count:digests:checks in hexadecimal."""
    cell = F.transform(cells, lambda c, i: F.when((c["c"] != 0) | (c["k"] != 0), F.concat_ws(":", F.hex(i), F.hex(c["c"]), F.hex(c["k"]), F.hex(c["h"]))))
    return F.concat(m.cast("string"), F.lit(";"), F.array_join(F.filter(cell, lambda x: x.isNotNull()), ";"))


def with_next(docs: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """``docs`` with ``next``, a struct of ``carried`` of the row that follows by ``key`` (nulls first, ties by hash of the
    row); after the last comes the first. Rows are dealt into ranges of the key by quantiles; the first row of a range is also put at the end of the one before it, so no order spans two tasks."""
    docs = docs.withColumn("__k", F.coalesce(F.col(key), F.lit(-(2**63))).cast("long"))
    steps = docs.select(F.percentile_approx("__k", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("q")).first().q or []
    cuts = sorted(set(steps))
    if cuts:
        lit = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")  # a constant; from JSON, as literals are slow to put together
        half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.element_at(lit, half(s) + 1) < F.col("__k"), F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi"))))
        docs = docs.withColumn("__b", F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda s: s["lo"]))
    else:
        docs = docs.withColumn("__b", F.lit(0))
    firsts = docs.groupBy("__b").agg(F.min("__k").alias("__k"))
    ring = firsts.withColumn("__to", F.coalesce(F.lag("__b").over(Window.orderBy("__b")), F.max("__b").over(Window.partitionBy()))).select("__k", "__to")
    moved = docs.join(F.broadcast(ring), "__k").withColumn("__b", F.col("__to")).drop("__to").withColumn("__tail", F.lit(1))  # at most one row a range
    rows = docs.withColumn("__tail", F.lit(0)).unionByName(moved.select(*docs.columns, "__tail"))
    order = Window.partitionBy("__b").orderBy("__tail", "__k", F.xxhash64(*carried))
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("__tail = 0").drop("__k", "__b", "__tail")


def ranges_for(docs: DataFrame, text: str = "text") -> int:
    """Ranges of about RANGE_CHARS characters."""
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return min(RANGES, max(16, -(-chars // RANGE_CHARS)))


def edited_pairs(docs: DataFrame, buckets: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document with its fingerprint and that of its edited text: the last half of the characters (rounded
    down) replaced by as many of the next document's first ones. Null texts are empty; a lone document follows itself; rows
    that repeat an id follow each other by a hash of the text. ``peeled`` says that both differences came out whole; where a
    cell is left after the largest attempt, what was recovered counts. Other columns don't matter."""
    buckets = buckets or ranges_for(docs, text)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("keys", keys_of(F.col("text"))), key, ["text", "keys"], buckets)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.select(key, "n_chars", "keys", "edited", F.col("next.keys").alias("next_keys")).withColumn("edited_keys", keys_of(F.col("edited")))
    rows = rows.withColumn("m", cells_for(F.size("keys"))).withColumn("cells", table(F.col("keys"), F.col("m"))).withColumn("em", cells_for(F.size("edited_keys")))
    rows = rows.withColumn("ecells", table(F.col("edited_keys"), F.col("em")))
    rows = with_comparison(with_comparison(rows, "keys", "edited_keys", "to_edited", "cells", "m"), "keys", "next_keys", "to_next", "cells", "m")
    return rows.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("cells"), F.col("m")).alias("fingerprint"),
        as_text(F.col("ecells"), F.col("em")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("m"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("cells"), F.col("m"), F.col("to_next")).alias("near_next"),
        ((F.col("to_edited.left") == 0) & (F.col("to_next.left") == 0)).alias("peeled"),
    )
