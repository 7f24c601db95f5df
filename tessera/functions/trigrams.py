"""Nearest texts by cosine of tf-idf weighted character trigrams, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Stands after a text that is too short for a trigram; no character.
_END = chr(0x10FFFF)
#: A trigram is multiplied densely if this share of a block's texts hold it; pairs of texts that share others are summed up.
DENSE = 0.06
#: Pairs summed up at once.
STEP = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, code) of every trigram of the texts, a blank before and after each."""
    padded = [f" {t} " if t else f"  {_END}" for t in texts]
    size = np.array([len(t) for t in padded])
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(padded)), size)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    return owner[at], c[at] << 42 | c[at + 1] << 21 | c[at + 2]


def _code(gram: str) -> int:
    a, b, c = map(ord, gram.ljust(3, _END))
    return a << 42 | b << 21 | c


def _unit(texts: list[str], grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of unit vectors, sorted by row and column. ``grams``: sorted codes, ``idf``: their weights."""
    row, code = _codes(texts)
    column = np.searchsorted(grams, code)
    known = grams[np.minimum(column, len(grams) - 1)] == code
    cell, times = np.unique(row[known] * len(grams) + column[known], return_counts=True)
    row, column = np.divmod(cell, len(grams))
    weight = (1 + np.log(times)) * idf[column]
    norm = np.sqrt(np.bincount(row, weight * weight, len(texts)))
    return row, column, weight / norm[row]


class _Block:
    """Texts of one side that keep their k nearest of the other."""

    def __init__(self, ids: np.ndarray, texts: list[str], grams: np.ndarray, idf: np.ndarray, k: int):
        self.ids, self.grams, self.idf, self.k, self.n = ids, grams, idf, k, len(ids)
        row, column, weight = _unit(texts, grams, idf)
        often = np.bincount(column, minlength=len(grams)) >= max(DENSE * self.n, 1)
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((self.n, int(often.sum())))
        here = often[column]
        self.dense[row[here], self.place[column[here]]] = weight[here]
        row, column, weight = row[~here], column[~here], weight[~here]
        order = np.argsort(column, kind="stable")
        self.row, self.weight = row[order], weight[order]
        self.ends = np.searchsorted(column[order], np.arange(len(grams) + 1))
        self.kth = np.zeros(self.n)
        self.held = tuple(np.empty(0, dtype=t) for t in (np.int64, np.float64, np.int64, np.int64))  # index, sim, least, id

    def meet(self, ids: np.ndarray, least: np.ndarray, texts: list[str]) -> None:
        m = len(texts)
        row, column, weight = _unit(texts, self.grams, self.idf)
        at = self.place[column]
        here = at >= 0
        theirs = np.zeros((m, self.dense.shape[1]))
        theirs[row[here], at[here]] = weight[here]
        sims = (self.dense @ theirs.T).ravel()
        row, column, weight = row[~here], column[~here], weight[~here]
        times = self.ends[column + 1] - self.ends[column]
        upto = np.cumsum(times)
        start = 0
        while start < len(times):  # a text's one trigram meets a block's share of texts at most
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + STEP)))
            t = times[start:stop]
            mine = np.arange(t.sum()) + np.repeat(self.ends[column[start:stop]] - (np.cumsum(t) - t), t)
            np.add.at(sims, self.row[mine] * m + np.repeat(row[start:stop], t), self.weight[mine] * np.repeat(weight[start:stop], t))
            start = stop
        sims = np.round(sims.reshape(self.n, m), 12)
        bar = self.kth
        if m > self.k:
            bar = np.maximum(bar, np.partition(sims, m - self.k, axis=1)[:, m - self.k])
        i, j = np.nonzero((sims >= bar[:, None]) & (sims > 0))
        held = [np.concatenate(x) for x in zip(self.held, (i, sims[i, j], least[j], ids[j]), strict=True)]
        order = np.lexsort((held[3], held[2], -held[1], held[0]))
        held = [x[order] for x in held]
        first = np.searchsorted(held[0], np.arange(self.n))
        place = np.arange(len(order)) - first[held[0]]
        last = place == self.k - 1
        self.kth[held[0][last]] = held[1][last]
        self.held = tuple(x[place < self.k] for x in held)

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"a": self.ids[self.held[0]], "b": self.held[3], "sim": self.held[1]})


def nearest(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """(a, b, sim) for each id of a block and its k nearest, ties to the smaller ``least``. A block is a number of rows with one
    (country, block), by ``kind``: 0 tells weights (text: trigram, idf), 1 its texts, 2 those they are compared with."""
    now, block, known = None, None, []
    for batch in batches:
        for country, number, kind, rows in zip(*(batch[x] for x in ("country", "block", "kind", "rows")), strict=True):
            if now != (country, number):
                if block:
                    yield block.found()
                now, block, known = (country, number), None, []
            if kind == 0:
                known += [(_code(r["text"]), r["idf"]) for r in rows]
                continue
            if not known:  # no trigram is on two records
                continue
            ids, texts = np.array([r["id"] for r in rows], dtype=np.int64), [r["text"] for r in rows]
            if kind == 1:
                known.sort()
                block = _Block(ids, texts, np.array([x for x, _ in known], dtype=np.int64), np.array([x for _, x in known]), k)
            else:
                block.meet(ids, np.array([r["least"] for r in rows], dtype=np.int64), texts)
    if block:
        yield block.found()
