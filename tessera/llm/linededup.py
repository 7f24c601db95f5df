"""Removal of repeated and nearly repeated lines, in DataFrame operations only (a segment-partition edit join, PassJoin).

Every line that isn't empty takes part. It goes if the same line occurs earlier (by document id, then by position) or, from
NEAR_LEAST characters on, one within tau edits, where tau grows with the length of the shorter of the two: 1 under LONGER
characters, 1 more for each further factor of BAND. To find the latter, a line of length l is cut into tau + 1 segments; by
the pigeonhole principle a line within tau edits holds one of them unchanged, near the same place. So each line indexes its
segments under (length, number, text), and probes for lines of its own length and of up to tau less with the substrings at
the places that multi-match-aware selection leaves. What meets is verified by a banded bit-parallel edit distance, after
what both lines begin and end with is taken off, which changes no distance.

Different lines that hold one segment (variants of one passage) meet in cells of bounded size, and there by their letters
first: an edit changes how often two letters occur at most, so lines whose counts' parities differ in more than 2 tau
letters are no pair, nor are those whose pairs of neighbours differ in more than 4 tau classes. The rest is verified there,
and only near lines become a row. So a segment that n lines hold costs n squared comparisons of two numbers, spread over
cells, but no n squared rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import spread_join
from tessera.session import materialize, release

#: Edits that nearly equal lines are apart at most, where they are given for all lengths (None: by length); the length from
#: which two are allowed, and the factor of length that allows one more.
TAU, LONGER, BAND = None, 100, 4
#: Characters of a line that takes part, and of one that is compared for near
#: equality: in shorter ones an edit is most of a word or number, and "12" is no copy of "13".
LEAST, NEAR_LEAST = 1, 8
#: Lines of a segment that meet in one cell, on average.
CROWD = 256
#: Line ids (8 bytes each) that are sent to all executors at most; more of them are joined by a shuffle.
LISTED = 1_000_000
#: Letters whose counts are compared before a pair of lines is; columns of the distance's band that are tried before the rest.
LETTERS, TRIED = "etaoinshrdlucmfwypvbgkjqxz .,-0123456789", 24


def bands(longest: int, tau: int | None) -> list[tuple[int, int, int]]:
    """(tau, least, most) of the bands of length, up to the longest line."""
    if tau is not None:
        return [(tau, max(NEAR_LEAST, tau + 1), longest)]
    out, least, most = [], NEAR_LEAST, LONGER - 1
    while least <= longest:
        out.append((len(out) + 1, least, most))
        least, most = most + 1, (most + 1) * BAND - 1
    return out


def _table(rows: list[dict], schema: str) -> Column:
    """A constant array of structs; from JSON, as long ones are slow to put together from literals."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def _places(tau: int, least: int, most: int, own: bool) -> list[dict]:
    """What a line looks for, or with ``own`` indexes, in lines of ``less`` characters less that are in the band of ``least``
    to ``most`` characters: the segments (``i`` from 0) and by how many characters each may have moved."""
    out = []
    for less in [0] if own else range(tau + 1):
        moves = lambda i: [0] if own else range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)  # noqa: B023, E731
        parts = [{"i": i, "move": m} for i in range(tau + 1) for m in moves(i)]
        out.append({"tau": tau, "less": less, "least": least, "most": most, "parts": parts})
    return out


def _keys(line: Column, n: Column, table: Column) -> Column:
    """Keys (length, number, text) of the segments that ``table`` (as ``_places`` gives it) names: tau + 1 even parts, the
    longer ones last. As no line is shorter than tau + 1 and no move beyond what is left and right of a segment, all lie
    within the line. Texts are cut from 4 bytes a character, where a place needs no search."""

    def cut(g: Column) -> Column:
        other = n - g["less"]
        short = F.floor(other / (g["tau"] + 1)).cast("int")
        # the first of the longer segments, and what each step from there adds
        return F.struct(other.alias("other"), short.alias("short"), (g["tau"] + 1 - (other - short * (g["tau"] + 1))).alias("from"), g["parts"].alias("parts"))

    def spots(c: Column, text: Column) -> Column:
        def spot(p: Column) -> Column:
            at = c["short"] * p["i"] + F.greatest(p["i"] - c["from"], F.lit(0)) + p["move"]
            return F.xxhash64(c["other"], p["i"], F.substring(text, at * 4 + 1, F.when(p["i"] >= c["from"], c["short"] + 1).otherwise(c["short"]) * 4))

        return F.transform(c["parts"], spot)

    fitting = F.filter(table, lambda g: (n - g["less"]).between(g["least"], g["most"]))
    once = F.transform(F.array(F.encode(line, "UTF-32")), lambda text: F.flatten(F.transform(F.transform(fitting, cut), lambda c: spots(c, text))))
    return F.element_at(once, 1)


def _by_band(n: Column, cut: list[tuple[int, int, int]], rows, schema: str, own: bool) -> Column:
    """The constant table of ``rows`` (of tau, least and most) for the band of a line of n characters; without ``own``, for a
    line little longer than the band before, that one's as well."""
    table, before = F.array().cast(f"array<struct<{schema}>>"), None
    for tau, least, most in cut:
        here = rows(tau, least, most)
        table = F.when(n.between(least, most), _table(here, schema)).otherwise(table)
        if before and not own:
            table = F.when(n.between(least, min(most, least - 1 + before[0]["tau"])), _table(here + before, schema)).otherwise(table)
        before = here
    if before and not own:
        table = F.when(n > cut[-1][2], _table(before, schema)).otherwise(table)
    return table


def segment_keys(line: Column, n: Column, cut: list[tuple[int, int, int]], own: bool) -> Column:
    """Keys that a line of n characters indexes (``own``), or has to look for in its own band and, where it is little longer
    than the one before, in that. One expression for all bands, driven by tables."""
    schema = "tau: int, less: int, least: int, most: int, parts: array<struct<i: int, move: int>>"
    return _keys(line, n, _by_band(n, cut, lambda *band: _places(*band, own), schema, own))


def letter_parity(line: Column) -> Column:
    """A bit for each of LETTERS: whether the line holds it an odd number of times. An edit changes two bits at most, so lines
    within tau edits differ in 2 tau bits at most."""
    bits = [F.length(F.replace(line, F.lit(c), F.lit(""))).cast("long").bitwiseAND(1) for c in LETTERS]
    size = F.length(line).cast("long").bitwiseAND(1)  # an odd count is an odd difference of the lengths
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(b.bitwiseXOR(size), i) for i, b in enumerate(bits)])


def pair_parity(line: Column, n: Column) -> Column:
    """A bit for each of 64 classes of two neighbouring characters: whether the line holds an odd number of them. An edit
    changes four bits at most."""
    text = F.array(F.encode(line, "UTF-32"))  # 4 bytes a character, where a place needs no search
    bit = lambda t, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.substring(t, i * 4 + 1, F.lit(8))), F.lit(64)).cast("int"))
    return F.element_at(F.transform(text, lambda t: F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0).cast("long"), lambda w, i: w.bitwiseXOR(bit(t, i)))), 1)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def without_common_ends(a: Column, b: Column, tau: Column | int) -> Column:
    """One array of one struct (a, b, tau): both lines without what they begin and end with alike, but for tau + 1 characters of it at each end: the edit distance
    stays the same. Lengths are found by halving steps, the first one the largest power of two within the shorter line."""
    n, m = F.length(a), F.length(b)
    both = F.struct(a.alias("a"), b.alias("b"), n.alias("n"), m.alias("m"), F.least(n, m).alias("least"), _column(tau).alias("tau"))

    def steps(x: Column) -> Column:
        top = F.floor(F.log2(F.greatest(x["least"], F.lit(1)).cast("double"))).cast("int")
        return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def front(x: Column, p: Column, step: Column) -> Column:
        return F.when((p + step <= x["least"]) & (F.substring(x["a"], F.lit(1), p + step) == F.substring(x["b"], F.lit(1), p + step)), p + step).otherwise(p)

    def back(x: Column, s: Column, step: Column) -> Column:
        to = s + step
        return F.when((to <= x["least"] - x["front"]) & (F.substring(x["a"], x["n"] - to + 1, to) == F.substring(x["b"], x["m"] - to + 1, to)), to).otherwise(s)

    def ends(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("a", "b", "n", "m", "least", "tau")], F.aggregate(steps(x), F.lit(0), lambda p, step: front(x, p, step)).alias("front"))

    def rest(x: Column) -> Column:
        keep = lambda p: F.greatest(p - x["tau"] - 1, F.lit(0))
        end = keep(F.aggregate(steps(x), F.lit(0), lambda s, step: back(x, s, step)))
        at = keep(x["front"])
        return F.struct(F.substring(x["a"], at + 1, x["n"] - at - end).alias("a"), F.substring(x["b"], at + 1, x["m"] - at - end).alias("b"), x["tau"].alias("tau"))

    return F.transform(F.transform(F.array(both), ends), rest)


def within(a: Column, b: Column, tau: Column | int) -> Column:
    """Whether two lines are tau edits apart at most. One expression, so that what is left of them is found once."""
    return F.element_at(F.transform(without_common_ends(a, b, tau), lambda x: banded_distance(x["a"], x["b"], x["tau"]) <= x["tau"]), 1)


def banded_distance(a: Column, b: Column, tau: Column | int) -> Column:
    """Edit distance of two lines whose lengths differ by tau at most and are above tau, exact where it is tau or less, by
    Hyyro's bit-parallel algorithm on a band of 2 tau + 1 diagonals: one step of bit operations for each character of b.
    Bit k of a word stands for row (column - tau + k); the band's lowest diagonal is followed to the last row, which is
    then followed to the last column. The last row lowers the distance by 2 tau at most, so beyond 3 tau the rest is not
    looked at; most lines that differ do so at once, so TRIED columns come first, and only their characters."""
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    left = lambda x, k: F.call_function("shiftleft", x, k)
    right = lambda x, k: F.call_function("shiftright", x, k)

    def run(x: Column, last: Column) -> Column:
        """Over the columns up to ``last``."""
        tau, full = x["tau"], x["full"]
        flip = lambda w: F.bitwise_not(w).bitwiseAND(full)
        start = F.struct(full.bitwiseXOR(left(F.lit(1), tau) - 1).alias("vp"), F.lit(0).alias("vn"), tau.alias("d"))

        def step(s: Column, i: Column) -> Column:
            c = F.get(x["b"], i)
            same = F.aggregate(F.sequence(F.lit(0), 2 * tau), F.lit(0), lambda w, k: F.when(F.get(x["a"], i - tau + k) == c, w.bitwiseOR(left(F.lit(1), k))).otherwise(w))
            words = lambda pm: F.struct((((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(pm).bitwiseOR(s["vn"])).bitwiseAND(full).alias("d0"))

            def after(w: Column) -> Column:
                d0, down = w["d0"], F.shiftright(w["d0"], 1)
                hp, hn = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))), d0.bitwiseAND(s["vp"])
                row = x["n"] - 1 - i + tau  # the bit of the last row in this column
                bit = lambda word: right(word, row).bitwiseAND(1)
                more = F.when(i < x["n"] - tau, F.when(right(d0, 2 * tau).bitwiseAND(1) == 0, 1).otherwise(0)).otherwise(bit(hp) - bit(hn))
                return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + more).alias("d"))

            return F.element_at(F.transform(F.transform(F.transform(F.array(same), lambda p: p), words), after), 1)

        return F.aggregate(F.sequence(F.lit(0), last), start, lambda s, i: F.when(s["d"] > 3 * tau, s).otherwise(step(s, i)), lambda s: s["d"])

    def some(x: Column, many: Column) -> Column:
        """The distance after ``many`` columns, of the characters that those need."""
        part = F.struct(chars(F.substring(x["a"], F.lit(1), many + x["tau"])).alias("a"), chars(F.substring(x["b"], F.lit(1), many)).alias("b"), x["n"].alias("n"), x["m"].alias("m"), x["tau"].alias("tau"), x["full"].alias("full"))
        return F.element_at(F.transform(F.array(part), lambda y: run(y, many - 1)), 1)

    both = F.struct(a.alias("a"), b.alias("b"), F.length(a).alias("n"), F.length(b).alias("m"), _column(tau).alias("tau"), (left(F.lit(2), 2 * _column(tau)) - 1).alias("full"))
    # first the columns tried, then all of them if those leave it open: one expression, run over one or two numbers of columns
    counts = lambda x: F.array_distinct(F.array(F.least(x["m"], F.lit(TRIED)), x["m"]))
    far = F.lit(2**20)
    told = lambda x: F.aggregate(counts(x), F.lit(0), lambda d, many: F.when(d > 3 * x["tau"], d).otherwise(some(x, many)))
    return F.element_at(F.transform(F.array(both), lambda x: F.coalesce(told(x), far)), 1)


def near_pairs(own: DataFrame, cut: list[tuple[int, int, int]]) -> DataFrame:
    """(id, other) of different lines within the edits of the shorter one's band, both ways. ``own``: id, line, n; one row a
    line, however often it occurs. Equal ids don't prove equal lines, so the texts themselves are compared."""
    line, n = F.col("line"), F.col("n")
    some = own.where(n >= (cut[0][1] if cut else NEAR_LEAST)).select("id", "line", "n")
    held = some.select("id", F.explode(segment_keys(line, n, cut, True)).alias("key"))
    asked = some.select(F.col("id").alias("other"), F.explode(segment_keys(line, n, cut, False)).alias("key"))
    # most keys are held by the line that asks alone, and most others by two: those need no second look
    keys = held.groupBy("key").agg(F.count("*").alias("holders"), F.min("id").alias("low"), F.max("id").alias("high"))
    # a hash join, as keys are one row each and sorting what asks for them would cost more than all else
    met = materialize(asked.join(keys.hint("shuffle_hash"), "key").where("low <> other or high <> other"), "segments-met")
    two, many = met.where("holders <= 2"), met.where("holders > 2")
    # a line asks for its own segments too, so all lines that hold a segment are among those that ask for it
    ids = two.select(F.explode(F.array("low", "high", "other")).alias("id")).unionByName(many.select(F.col("other").alias("id"))).distinct()
    ids = materialize(ids, "met-ids")  # written, so that its size is known before texts move
    release()  # what the join above has shuffled
    ids = F.broadcast(ids) if ids.count() <= LISTED else ids
    texts = materialize(some.join(ids, "id", "left_semi").withColumn("letters", letter_parity(line)), "met-lines")
    side = lambda rows, key, p: rows.select(F.col("id").alias(key), F.col("line").alias(p), F.col("letters").alias(f"{p}_letters"), F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c in ("two", "keys")])
    shorter = F.least("a_n", "b_n")
    tau = reduce(lambda rest, band: F.when(shorter <= band[2], band[0]).otherwise(rest), reversed(cut), F.lit(cut[-1][0] if cut else 0))
    apart = lambda c: F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    possible = (F.abs(F.col("a_n") - F.col("b_n")) <= tau) & (apart("letters") <= 2 * tau)
    pairs = two.select(F.explode(F.array("low", "high")).alias("id"), "other").where("id <> other")
    pairs = materialize(pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct(), "line-pairs")
    near = pairs.join(side(texts, "id", "a"), "id").join(side(texts, "other", "b"), "other").where(possible).where(within(F.col("a"), F.col("b"), tau)).select("id", "other")
    # lines of a segment with more holders are compared where they meet, by what rules them out most cheaply first; only those that are near become rows
    sizes = many.select("key", "holders").distinct()
    parts = F.ceil(F.col("holders") / max(CROWD, 1)).cast("int")
    ids = materialize(many.select(F.col("other").alias("id")).distinct(), "crowded-ids")
    crowd = materialize(texts.join(ids, "id", "left_semi").withColumn("two", pair_parity(line, n)).withColumn("keys", segment_keys(line, n, cut, True)), "crowded-lines")
    ours = side(crowd, "id", "a").withColumn("key", F.explode("a_keys")).drop("a_keys").join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("holders")
    theirs = many.select(F.col("key").alias("asked"), "other", "holders").join(side(crowd, "other", "b").drop("b_keys"), "other").withColumn("of", F.explode(F.sequence(F.lit(0), parts - 1))).drop("holders")
    meets = (F.col("key") == F.col("asked")) & (F.col("part") == F.col("of")) & (F.col("id") != F.col("other"))
    more = ours.join(theirs, meets & possible & (apart("two") <= 4 * tau) & within(F.col("a"), F.col("b"), tau)).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    near = near.unionByName(more).distinct()
    return near.unionByName(near.select(F.col("other").alias("id"), F.col("id").alias("other")))


def with_uid(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("__uid", F.xxhash64(F.col(key), F.col(text)))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int | None = TAU, least: int = LEAST) -> DataFrame:
    """(__key, __gone, dropped: positions from 0, ascending) of the documents that lose a line."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    lines = with_uid(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col("__uid").alias("uid"), F.posexplode(cut).alias("pos", "line")).where(F.length("line") >= least)
    lines = lines.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))
    place = F.struct("key", "uid", "pos")
    # the text goes along once a line and map task; keys are made once a line, not once an occurrence
    own = materialize(lines.groupBy("id", "id2").agg(F.count("*").alias("times"), F.min(place).alias("first"), F.first("line").alias("line")).withColumn("n", F.length("line")), "lines")
    size = own.agg(F.max("n").alias("longest"), F.sum("times").alias("every")).first()
    release()
    cut = bands(size.longest or 0, tau)
    near = materialize(near_pairs(own, cut), "line-links")
    release()
    firsts = own.groupBy("id").agg(F.min("first").alias("first"))  # one row an id but for collisions
    linked = near.join(firsts.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("first").alias("earliest"))
    told = own.join(linked, "id", "left").withColumn("late", F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)))
    told = materialize(told.where("times > 1 or late").select("id", "id2", "first", "late", "times"), "told-lines")
    gone = spread_join(lines.select("key", "uid", "pos", "id", "id2"), told, ["id", "id2"], "times", size.every or 0, ["uid", "pos"])
    gone = gone.where(F.col("late") | (F.struct("key", "uid", "pos") != F.col("first")))
    return gone.groupBy(F.col("key").alias("__key"), F.col("uid").alias("__gone")).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int | None = TAU, least: int = LEAST) -> DataFrame:
    """``docs`` without the dropped lines, with ``n_lines`` and ``dropped`` (columns of these names are replaced). A null text
    stays null and has no lines; a text that loses all becomes empty. Rows that repeat a document with the same id and text
    share its decisions; copies under other ids lose what the first has."""
    rows = with_uid(docs.drop("n_lines", "dropped"), key, text)
    gone = dropped_lines(docs, key, text, tau, least)
    joined = rows.join(gone, (F.col("__uid") == F.col("__gone")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__gone", "__key")
    cut = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    joined = joined.withColumn("n_lines", F.coalesce(F.size(cut), F.lit(0))).withColumn(text, F.when(F.col("dropped").isNull(), F.col(text)).otherwise(kept))
    out = joined.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__uid"], "n_lines", "dropped")
