"""Exact top-k inner products over norm buckets (after Teflioudi and Gemulla's LEMP).

Vectors are ordered by length and cut into buckets of like lengths. A query that already has k results of score t needs
from a bucket of largest length L only vectors whose cosine with it is t / (|q| L) or more, its local threshold. Over 1
prunes the bucket. A high one prunes by coordinates: each of the query's largest coordinates bounds what a vector of that
cosine can have there. A low one prunes by length alone: vectors shorter than t / |q| end the scan. What remains is
verified by full products. Queries are dealt in blocks of like lengths and buckets in groups of like lengths. All blocks meet
the group of the longest vectors first; the k-th scores found there are the thresholds with which a block goes on, to the
groups alone that one of its queries could still gain from. A cell holds one block and one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Vectors of a bucket, buckets of a group, queries of a block.
BUCKET, GROUP, BLOCK = 2048, 8, 1024
#: Local thresholds from which coordinates prune; coordinates of the query that are looked at.
BY_COORDINATE, FOCUS = 0.6, 4
EXACT = float(2**53)
#: Below every score, and its negative fits too.
NONE = np.iinfo("int64").min + 1


def usable(vector: Column) -> Column:
    """Neither null nor empty nor holding null, NaN or an infinity."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda x: fine(x.cast("double"))), F.lit(False))


def bucketed(vectors: DataFrame, size: int, group: int, partitions: int | None = None) -> DataFrame:
    """``vectors`` (vec_id long, v array<double>) packed by length, longest first: (grp, bucket, top: the largest length, ids,
    data, dim). The range partitioning is by length and then id, so equal lengths are spread as well; a group is ``group``
    buckets that follow each other, so a hot length only makes more groups."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select("vec_id", "v", norm.alias("norm"))
    order = (F.desc("norm"), F.asc("vec_id"), F.xxhash64("v"))
    dealt = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, ids, held = None, 0, [], []

        def packed():
            x = np.array(held)
            return pd.DataFrame({"grp": [f"{part}-{n // group}"], "bucket": [f"{part}-{n}"], "top": [float(np.sqrt((x[0] * x[0]).sum()))], "ids": [np.array(ids, dtype="<i8").tobytes()], "data": [x.astype("<f8").tobytes()], "dim": [x.shape[1]]})

        for batch in batches:
            for p, i, v in zip(batch["part"], batch["vec_id"], batch["v"], strict=True):
                if held and (len(held) == size or len(v) != len(held[0])):
                    yield packed()
                    n, ids, held = n + 1, [], []
                part = p
                ids.append(i)
                held.append(v)
        if held:
            yield packed()

    return dealt.withColumn("part", F.spark_partition_id()).select("part", "vec_id", "v").mapInPandas(pack, "grp string, bucket string, top double, ids binary, data binary, dim int")


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, dtype="<i8"), np.frombuffer(row.data, dtype="<f8").reshape(-1, row.dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact for integer-valued vectors: in doubles while no sum can pass 2^53, else in Python's integers."""
    if not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return (q @ x.T).astype("int64")
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], dtype="int64").reshape(len(q), len(x))


class _Best:
    """The k best of each query of a block so far, ties to the smaller id. ``floor``: scores known from elsewhere that k
    vectors reach."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), np.iinfo("int64").max)
        self.full = np.zeros(len(ids), dtype=bool)

    @property
    def least(self) -> np.ndarray:
        return np.maximum(np.where(self.full, self.score[:, -1].astype(float), -np.inf), self.floor)

    def found(self, block: str) -> pd.DataFrame:
        r, c = np.nonzero(self.vec != np.iinfo("int64").max)
        return pd.DataFrame({"block": block, "place": r.astype("int32"), "query_id": self.ids[r], "vec_id": self.vec[r, c], "score": self.score[r, c]})

    def add(self, rows: np.ndarray, vec: np.ndarray, scores: np.ndarray) -> None:
        """scores: rows by vec; a query's own vector does not count."""
        scores = np.where(self.ids[rows][:, None] == vec[None, :], NONE, scores)
        if scores.shape[1] > 4 * self.k:  # ties with the k-th stay in
            cut = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            keep = (scores >= cut[:, None]).any(axis=0)
            scores, vec = scores[:, keep], vec[keep]
        s = np.concatenate((self.score[rows], scores), axis=1)
        v = np.concatenate((self.vec[rows], np.broadcast_to(vec, scores.shape)), axis=1)
        v = np.where(s == NONE, np.iinfo("int64").max, v)
        order = np.lexsort((v, -s.astype("float64") if np.abs(s[s != NONE]).max(initial=0) < EXACT else _descending(s)), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
        self.full[rows] = self.vec[rows, -1] != np.iinfo("int64").max


def _descending(s: np.ndarray) -> np.ndarray:
    return ~s  # reverses the order of 64-bit integers without overflow


def search_bucket(q: np.ndarray, q_norm: np.ndarray, best: _Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Adds a bucket (x, longest first) to the best of all queries of a block."""
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isfinite(best.least), best.least / (q_norm * norm[0]), -np.inf)
    local = np.where(np.isnan(local), -np.inf, local) * (1 - 1e-12)
    high = (local >= BY_COORDINATE) & (local <= 1)
    for r in np.flatnonzero(high):
        unit, cos = q[r] / q_norm[r], local[r]
        keep = np.arange(np.searchsorted(-norm, -best.least[r] / q_norm[r] * (1 - 1e-12), "right"))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            # a unit vector of that cosine or more lies within the angle arccos(cos) of the query, in this coordinate too
            here, wide = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(np.clip(cos, -1, 1)) + 1e-9
            share = x[keep, f] / np.maximum(norm[keep], 1e-300)
            keep = keep[(share <= np.cos(max(0.0, here - wide)) + 1e-9) & (share >= np.cos(min(np.pi, here + wide)) - 1e-9)]
        if len(keep):
            best.add(np.array([r]), ids[keep], _products(q[r : r + 1], x[keep]))
    low = np.flatnonzero(local < BY_COORDINATE)
    if len(low):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(best.least[low] > 0, best.least[low] / q_norm[low], 0.0).min() * (1 - 1e-12)
        n = int(np.searchsorted(-norm, -need, "right"))
        if n:
            best.add(low, ids[:n], _products(q[low], x[:n]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, group: int = GROUP, partitions: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query with every other row, ties to the smaller
    vec_id; all, if there are fewer. ``vectors``: vec_id long, v array<double> of whole numbers, with no nulls (``usable``).
    Vectors of another dimension than the query's are no candidates. Every query row has a result of its own, also where
    rows repeat a vec_id: then rows of the query's id are its own, and no candidates, and rows of another repeated id are
    candidates each."""
    packed = materialize(bucketed(vectors.select("vec_id", "v"), BUCKET, group, partitions), "buckets")
    asked = materialize(bucketed(vectors.where(is_query).select("vec_id", "v"), BLOCK, 1, partitions), "blocks").select(F.col("bucket").alias("block"), F.col("ids").alias("qids"), F.col("data").alias("q"), F.col("dim").alias("qdim"))
    groups = packed.groupBy("grp").agg(F.max("top").alias("top"))  # one row for BUCKET * group vectors
    longest = groups.orderBy(F.desc("top"), "grp").limit(1).select("grp")
    schema = "block string, place int, query_id long, vec_id long, score long"

    def meet(queries: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(buckets):
            return pd.DataFrame({"block": [], "place": [], "query_id": [], "vec_id": [], "score": []})
        block = queries.iloc[0]
        ids, q = np.frombuffer(block.qids, dtype="<i8"), np.frombuffer(block.q, dtype="<f8").reshape(-1, block.qdim)
        floor = np.frombuffer(block.floor, dtype="<f8") if block.floor is not None else None
        best, q_norm = _Best(ids, k, floor), np.sqrt((q * q).sum(axis=1))
        for row in buckets.sort_values(["top", "bucket"], ascending=[False, True]).itertuples():
            vec, x = _open(row)
            if x.shape[1] == q.shape[1]:
                search_bucket(q, q_norm, best, vec, x)
        return best.found(block.block)

    def search(cells: DataFrame) -> DataFrame:
        """cells: (block, grp, floor)."""
        left = asked.join(cells, "block")
        right = packed.join(cells.select("block", "grp"), "grp").select(F.col("block").alias("for_block"), F.col("grp").alias("in_grp"), "bucket", "top", "ids", "data", "dim")
        return left.groupBy("block", "grp").cogroup(right.groupBy("for_block", "in_grp")).applyInPandas(meet, schema)

    names = asked.select("block").withColumn("floor", F.lit(None).cast("binary"))
    seeds = materialize(search(names.join(F.broadcast(longest))), "seeds")  # one group for all blocks: one row

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th score of each query of a block, and the length from which a vector can add to one of them."""
        for batch in batches:
            for block, qids, data, dim, told in zip(batch["block"], batch["qids"], batch["q"], batch["qdim"], batch["told"], strict=True):
                n = len(qids) // 8
                norm = np.sqrt((np.frombuffer(data, dtype="<f8").reshape(-1, dim) ** 2).sum(axis=1))
                floor = np.full(n, -np.inf)
                for place, least in [] if told is None else [(t["place"], t["least"]) for t in told]:
                    floor[place] = least
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor > 0, floor / norm, 0.0).min(initial=np.inf) * (1 - 1e-12)
                yield pd.DataFrame({"block": [block], "floor": [floor.tobytes()], "need": [need]})

    kth = seeds.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    kth = kth.groupBy("block").agg(F.collect_list(F.struct("place", F.col("least").cast("double").alias("least"))).alias("told"))  # BLOCK entries at most
    needs = materialize(asked.join(kth, "block", "left").mapInPandas(floors, "block string, floor binary, need double"), "thresholds")
    # which block goes to which group: names and lengths alone, one row for BLOCK queries and one for BUCKET * group vectors
    others = groups.join(longest, "grp", "left_anti")
    cells = materialize(needs.join(others, F.col("top") >= F.col("need")).select("block", "grp", "floor"), "cells")
    found = seeds.unionByName(search(cells))
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
