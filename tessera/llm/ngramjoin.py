"""N-gram Jaccard join by MinHash banding, with every candidate verified on full n-gram sets.

Texts with equal n-gram sets are one class from the start, so copies are never expanded into pairs. The number of bands and
rows follows from the recall wanted at the threshold. Classes that share a band's hash are in one bucket. Each class belongs
to the largest of its buckets; the classes of a bucket are dealt into parts of bounded size, and two parts (or one with
itself) make a cell if some bucket holds classes of both. So every pair that shares a band meets in exactly one cell, however
many bands it shares, and classes that a chain of others ties together don't. Classes whose number of n-grams rules out the
similarity with all others of a bucket are not in it. A cell verifies its pairs on full n-gram sets
and puts out counts and a spanning forest, not pairs: links grow with the square of a group, rows do not.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import worker
from tessera.llm.graph import connected_components
from tessera.llm.skew import sifted, spread_join
from tessera.session import materialize

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Hashes of a signature at most; classes of a part, on average.
HASHES, CHUNK = 160, 256
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Most rows (fewest false candidates) for which bands enough for the recall at the threshold fit in the hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's words (lower case, cut at white space). A text of fewer words
    has one, of all of them; a text without words none."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _ROLL + h[i : len(h) - size + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _ROLL
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), 512):
            x = grams[i : i + 512, None] * a
            x += b
            np.minimum(least, x.min(axis=0), out=least)
    return least


def set_key(grams: np.ndarray) -> bytes | None:
    """What texts of one n-gram set share; none for a text without words, which is like no other."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def packed(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: what a set takes on its way to a cell. A pair of sets of 20,000 each has two hashes that
    fall together once in 700,000 such pairs."""
    return (grams >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    found = out.view("<u8").ravel()
    return found if (found[1:] != found[:-1]).all() else np.unique(found)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, uid, key, grams, bands) of ``docs`` (doc_id long, text). Ids stay out of Python, where a batch that holds a null would
    turn them into inexact numbers."""

    @F.pandas_udf("key binary, grams int, bands array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        worker.use("ngramjoin")
        rng = np.random.default_rng(20240101)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        keys, sizes, all_bands = [], [], []
        for text in texts:
            grams = ngrams(text, n)
            keys.append(set_key(grams))
            sizes.append(len(grams))
            if len(grams):
                s = signature(grams, a, b).reshape(bands, rows)
                all_bands.append([xxhash.xxh64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(s)])
            else:
                all_bands.append(None)
        return pd.DataFrame({"key": keys, "grams": np.array(sizes, dtype="int32"), "bands": all_bands})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("uid"), signed("text").alias("s")).select("doc_id", "uid", "s.key", "s.grams", "s.bands")


def row_key() -> Column:
    """What rows of one id and one text share."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def verified(sets: list[np.ndarray], threshold: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets of that Jaccard similarity or more. ``first``: only pairs across that index."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(n, 1)
    if first is not None:
        keep = (i < first) & (j >= first)
        i, j = i[keep], j[keep]
    keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[keep], j[keep]
    if len(i) <= 4 * n:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    else:
        owner = np.repeat(np.arange(n), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), dtype=np.float32)
        step = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            lo, hi = np.searchsorted(column, (start, start + step))
            m = np.zeros((n, step), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - start] = 1
            both += m @ m.T
        shared = both[i, j].astype(np.int64)
    ok = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    return i[ok], j[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def level(grams: Column, threshold: float) -> Column:
    """0 to 62: sets of that similarity or more are on one level or on neighbours; the highest level holds all above."""
    return F.least(F.floor(F.log(grams) / (math.log(max(1 / threshold, 1.001)) + 1e-9)), F.lit(62)).cast("int")


def cells_of(classes: DataFrame, chunk: int, threshold: float) -> DataFrame:
    """(key, part, cells: array of (a, b)) of the classes that share a band with another whose size allows the similarity.
    ``classes``: key, grams, bands."""
    bands = classes.select("key", level(F.col("grams"), threshold).alias("level"), F.posexplode("bands").alias("band", "hash")).select("key", "level", F.xxhash64("band", "hash").alias("bucket"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_or(bit).alias("levels"))
    beside = F.col("levels").bitwiseAND(F.shiftright("levels", 1)) != 0
    sizes = materialize(sizes.withColumn("some", F.col("n") > F.bit_count("levels")).where(F.col("some") | beside), "buckets")
    met, buckets = sizes.agg(F.sum("n"), F.count("*")).first()
    bands = sifted(bands, F.col("bucket"), sizes, F.col("bucket"), buckets)  # most buckets hold one class
    ties = spread_join(bands, sizes, ["bucket"], "n", met or 0, ["key"])
    # where two are on one level, which one isn't known: all stay; else those beside another
    near = bit.bitwiseAND(F.shiftright("levels", 1).bitwiseOR(F.shiftleft("levels", 1))) != 0
    ties = materialize(ties.where(F.col("some") | near).select("key", "bucket", "n"), "ties")
    homes = materialize(ties.groupBy("key").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home")), "homes")
    groups = homes.groupBy("home").agg(F.count("*").alias("members"))
    nodes = spread_join(homes, groups, ["home"], "members", homes.count(), ["key"])
    nodes = materialize(nodes.select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / chunk))).alias("part")), "parts")
    met = ties.join(nodes, "key").groupBy("bucket", "part").agg(F.count("*").alias("n"))
    met = met.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))  # a row a part, not a class
    pairs = met.select(F.explode("parts").alias("x"), "parts").select("x", F.explode("parts").alias("y"))
    pairs = pairs.where("x.part < y.part or (x.part = y.part and x.n > 1)").select(F.col("x.part").alias("a"), F.col("y.part").alias("b")).distinct()
    placed = pairs.select(F.struct("a", "b").alias("cell"), F.explode(F.array_distinct(F.array("a", "b"))).alias("part")).groupBy("part").agg(F.collect_list("cell").alias("cells"))
    return nodes.join(placed, "part")


def linked(classes: DataFrame, docs: DataFrame, n: int, threshold: float, chunk: int) -> DataFrame:
    """(key, root, links): for each cell and class with a link in it, the cell's root of its tree and the number of documents
    in classes that are linked to it there. ``classes``: key, rep, size, grams, bands."""
    nodes = cells_of(classes, chunk, threshold).join(classes.select("key", "rep.uid", "size"), "key").withColumnRenamed("uid", "__rep")
    nodes = materialize(nodes, "nodes")
    texts = sifted(docs.select("text", row_key().alias("uid")), F.col("uid"), nodes, F.col("__rep"), nodes.count())  # texts are long, few meet another
    texts = texts.join(nodes, F.col("uid") == F.col("__rep"))

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series, keys: pd.Series) -> pd.Series:
        """Null where another row's key happens to be the same."""
        grams = (ngrams(t, n) for t in texts)
        return pd.Series([packed(g) if set_key(g) == bytes(k) else None for g, k in zip(grams, keys, strict=True)], dtype=object)

    # else Spark moves the filter below it, and a second worker a task cuts every text again
    shingles = shingles.asNondeterministic()
    rows = texts.select("key", "part", "cells", "size", shingles("text", "key").alias("grams")).where("grams is not null")
    # of rows that repeat one is enough: cells tell rows by key
    rows = rows.select(F.explode("cells").alias("cell"), "part", "key", "size", "grams").select("cell.a", "cell.b", "part", "key", "size", "grams")
    dealt = rows.repartition("a", "b").sortWithinPartitions("a", "b", "part", "key")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def close() -> pd.DataFrame:
            first = None if now[0] == now[1] else sum(r[0] == now[0] for r in held)  # parts ascend, a before b
            i, j = verified([unpacked(r[3]) for r in held], threshold, first)
            size = np.array([r[2] for r in held], dtype=np.int64)
            links = (np.bincount(i, size[j], len(held)) + np.bincount(j, size[i], len(held))).astype("int64")
            roots = _roots(len(held), i, j)
            return pd.DataFrame({"key": [r[1] for r in held], "root": [held[x][1] for x in roots], "links": links})[links > 0]

        for batch in batches:
            for a, b, part, key, size, grams in zip(*(batch[x] for x in ("a", "b", "part", "key", "size", "grams")), strict=True):
                if now != (a, b):
                    if len(held) > 1:
                        yield close()
                    now, held = (a, b), []
                if not held or held[-1][1] != key:
                    held.append((part, key, size, grams))
        if len(held) > 1:
            yield close()

    return dealt.mapInPandas(cells, "key binary, root binary, links long")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs``, as ``join_rows`` gives them."""
    return join_rows(docs, n, threshold, recall, chunk).select("doc_id", "class_id", "n_links")


def join_rows(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, class_id, n_links, uid, class_uid) of every row of ``docs`` (doc_id, text): the least doc_id of its connected
    component over links (Jaccard similarity of n-gram sets >= threshold), the number of rows it is linked to, and the row
    keys (``row_key``) of the row and of the component's first row by (doc_id, row key). Null and wordless texts are linked
    to nothing and are their own class. Rows that repeat an id come out repeated; a null id is never a class's id unless there
    is no other. Other columns don't matter."""
    bands, rows = bands_and_rows(threshold, recall)
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    classes = materialize(signed.where("key is not null").groupBy("key").agg(first.alias("rep"), F.count("*").alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "classes")
    found = materialize(linked(classes, docs, n, threshold, chunk), "links")
    groups = connected_components(found.select(F.col("key").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    told = classes.select("key", "rep", "size").join(groups.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    told = told.withColumn("component", F.coalesce("component", "key"))
    ids = told.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    told = spread_join(told, ids, ["component"], "members", classes.count(), ["key"])
    told = told.select("key", F.col("least.doc_id").alias("class_id"), F.col("least.uid").alias("class_uid"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size")
    told = materialize(told, "told")
    # texts without a word have no key: one of their own, so that they don't gather
    alone = F.col("key").isNull()
    out = signed.select("doc_id", "uid", alone.alias("alone"), F.coalesce("key", F.concat(F.lit("-"), F.col("uid").cast("string")).cast("binary")).alias("key"))
    out = spread_join(out, told, ["key"], "size", signed.count(), ["uid"], "left")
    own = lambda mine, theirs: F.when(F.col("alone"), F.col(mine)).otherwise(F.col(theirs)).alias(theirs)
    return out.select("doc_id", own("doc_id", "class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "uid", own("uid", "class_uid"))
