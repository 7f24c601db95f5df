"""Longest common subsequences and Jaro matches of many pairs of strings at once.

Strands are combed cell by cell (Tiskin's semi-local LCS): a strand comes in at each row and each column; in a cell two of
them swap if the letters are equal or if they have crossed before. What leaves at the bottom tells the subsequence of the whole
first string with every window of the second, so a window costs a count and not a comparison of its own. A cell is a few
operations on arrays over pairs of similar lengths; masks take the place of choices, which arrays are slow at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs combed at once, at most; fewer than FEW, and strings of more than LONGEST letters, take the caller's plain way.
PAIRS, FEW, LONGEST = 1024, 8, 400


def _letters(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Code points, a row each place and a column each text."""
    out = np.full((len(texts), width), pad, dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.ascontiguousarray(out.T)


def _comb(one: list[str], two: list[str]) -> tuple[np.ndarray, int]:
    """(strands that leave below each letter of ``two``, rows): of a strand, below the rows those that came in from the side,
    then the column where it came in."""
    m, n = max(map(len, one)), max(map(len, two))
    a, b = _letters(one, m, 0x110000), _letters(two, n, 0x110001)
    if max((x[x < 0x110000].max(initial=0) for x in (a, b))) < 254:
        a, b = np.where(a < 254, a, 254).astype(np.uint8), np.where(b < 254, b, 255).astype(np.uint8)
    kind = np.uint8 if m + n < 256 else np.uint16
    side = np.repeat(np.arange(m - 1, -1, -1, dtype=kind)[:, None], len(one), axis=1)
    below = np.repeat(np.arange(m + n - 1, m - 1, -1, dtype=kind)[:, None], len(one), axis=1)  # last column first
    b = np.ascontiguousarray(b[::-1])
    most = (min(m, n), len(one))
    flag, other, both = np.empty(most, bool), np.empty(most, kind), np.empty(most, kind)
    for d in range(m + n - 1):  # all cells of a diagonal at once
        lo, hi = max(0, d - n + 1), min(m, d + 1)
        k, at = hi - lo, n - 1 - d + lo
        row, down, f, o, t = side[lo:hi], below[at : at + k], flag[:k], other[:k], both[:k]
        np.not_equal(a[lo:hi], b[at : at + k], out=f)
        if kind is np.uint8:
            np.negative(f.view(np.uint8), out=o)
        else:
            np.multiply(f, kind(0xFFFF), out=o)
        np.add(row, down, out=t)  # the strands' sum, whichever goes where, may pass the type's end and come back
        np.bitwise_and(down, o, out=o)
        np.maximum(row, o, out=down)  # equal letters: the strands swap, whatever they are
        np.subtract(t, down, out=row)
    below = below[::-1]
    return below, m


def _many(one: list[str], two: list[str], out: list[np.ndarray], combed: Callable, plain: Callable) -> None:
    """Fill ``out`` for pairs that have letters on both sides, of similar lengths at once."""
    x, y = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (one, two))
    order = np.lexsort((y, x))
    order = order[(x[order] > 0) & (y[order] > 0)]
    for start in range(0, len(order), PAIRS):
        at = order[start : start + PAIRS]
        fits = (x[at] <= LONGEST) & (y[at] <= LONGEST)
        fits &= fits.sum() >= FEW
        for k in at[~fits].tolist():
            for o, v in zip(out, plain(one[k], two[k]), strict=True):
                o[k] = v
        fit = at[fits]
        if len(fit):
            places = fit.tolist()
            for o, v in zip(out, combed([one[k] for k in places], [two[k] for k in places]), strict=True):
                o[fit] = v


def lcs_many(one: list[str], two: list[str], lcs: Callable[[str, str], int]) -> np.ndarray:
    """Length of the longest common subsequence of each pair; ``lcs`` gives it for a single one."""

    def combed(a: list[str], b: list[str]) -> list[np.ndarray]:
        below, m = _comb(a, b)
        size = np.array([len(t) for t in b])
        return [size - ((below >= m) & (np.arange(len(below))[:, None] < size)).sum(axis=0)]

    out = np.zeros(len(one), dtype=np.int64)
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(one, two, strict=True)]
    _many([a for a, _ in short], [b for _, b in short], [out], combed, lambda a, b: [lcs(a, b)])
    return out


def best_windows(one: list[str], two: list[str], plain: Callable[[str, str], float], lcs: Callable[[str, str], int]) -> tuple[np.ndarray, np.ndarray]:
    """(lcs, best ratio of the shorter string with a window of its length of the longer, windows cut by the ends included) of
    each pair; 0 and 0 where a string is empty. ``plain`` and ``lcs`` give them for a single pair."""

    def combed(a: list[str], b: list[str]) -> list[np.ndarray]:
        below, m = _comb(a, b)
        n, places = len(below), np.arange(len(below))[:, None]
        short, size = np.array([len(t) for t in a]), np.array([len(t) for t in b])
        top = ((below >= m) & (places < size)).cumsum(axis=0, dtype=np.int32)
        whole = size - top[-1]
        best = np.zeros(len(a))
        pairs = np.arange(len(a))
        for end in range(1, m):  # windows that the beginning cuts
            e = np.minimum(end, size)
            found = 200.0 * (e - top[e - 1, pairs]) / (short + e)
            np.maximum(best, found, out=best, where=end < short)
        leaves = np.full((m + n, len(a)), n, dtype=np.int32)  # the column below which a strand leaves
        leaves[below, pairs] = places
        cross = top[short - 1, pairs]  # strands that come in at a window's columns and leave below them
        for i in range(n):  # the others; those that the end cuts are shorter
            width = np.minimum(short, size - i)
            found = 200.0 * (width - cross) / np.maximum(short + width, 1)
            np.maximum(best, found, out=best, where=width > 0)
            end = i + short
            cross -= below[i] >= m + i
            cross -= (leaves[m + i] > i) & (leaves[m + i] < np.minimum(end, size))
            cross += (end < size) & (below[np.minimum(end, n - 1), pairs] > m + i)
        return [whole, best]

    length, best = np.zeros(len(one), dtype=np.int64), np.zeros(len(one))
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(one, two, strict=True)]
    _many([a for a, _ in short], [b for _, b in short], [length, best], combed, lambda a, b: [lcs(a, b), plain(a, b)])
    return length, best


def jaro_many(one: list[str], two: list[str], plain: Callable[[str, str], float]) -> np.ndarray:
    """Jaro similarity of each pair, 0 where a string is empty; ``plain`` gives it for a single one."""

    def matched(a: list[str], b: list[str]) -> list[np.ndarray]:
        m, n = max(map(len, a)), max(map(len, b))
        x, y = _letters(a, m, 0x110000), _letters(b, n, 0x110001)
        la, lb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        far = int(reach.max())
        near = np.arange(far + 1)[:, None] <= reach
        met, free = np.zeros(x.shape, bool), np.ones(y.shape, bool)
        hit = np.empty(len(a), bool)
        for i in range(m):
            equal = x[i] == y[max(0, i - far) : i + far + 1]
            for j, e in enumerate(equal, max(0, i - far)):
                np.logical_and(e, free[j], out=hit)
                hit &= near[abs(i - j)]
                hit &= ~met[i]
                met[i] |= hit
                free[j] ^= hit
        count = met.sum(axis=0)
        owner = np.repeat(np.arange(len(a)), count)
        swaps = np.bincount(owner, x.T[met.T] != y.T[~free.T], len(a)).astype(np.int64) // 2
        c = np.maximum(count, 1)
        return [np.where(count > 0, (count / la + count / lb + (count - swaps) / c) / 3, 0.0)]

    out = np.zeros(len(one))
    _many(one, two, [out], matched, lambda a, b: [plain(a, b)])
    return out
