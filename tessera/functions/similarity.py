"""String similarity: bit-parallel longest common subsequence and what is built on it, as Pandas UDFs over batches."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.alignment import best_windows, jaro_many, lcs_many


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``a`` in one integer's bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 lcs / total length; two empty strings are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """0 if either has no token; 100 if one's tokens hold all of the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not one or not two):
        return 100.0
    s, s1, s2 = " ".join(both), " ".join(both + one), " ".join(both + two)
    best = ratio(s1, s2)
    if both:  # the shared part is a prefix of either
        best = max(best, 200.0 * len(s) / (len(s) + len(s1)), 200.0 * len(s) / (len(s) + len(s2)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, windows cut by the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    windows = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(ratio(a, w) for w in windows)


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a common prefix of up to four letters where it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + 0.1 * same * (1 - j)


def lcs_share(a: str, b: str) -> float:
    return lcs(a, b) / max(len(a), len(b)) if a or b else 1.0


def _ratios(a: list[str], b: list[str], length: np.ndarray | None = None) -> np.ndarray:
    length = lcs_many(a, b, lcs) if length is None else length
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    return np.where(size > 0, 200.0 * length / np.maximum(size, 1), 100.0)


def _each(f, texts: list[str]) -> list:
    """``f`` of every text, told once for texts that repeat: a record is in many pairs."""
    known = {t: f(t) for t in set(texts)}
    return [known[t] for t in texts]


def _in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


def _sorted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return _ratios(_each(_in_order, a), _each(_in_order, b))


def _words(text: str) -> tuple[set[str], list[str]]:
    words = set(text.split())
    return words, sorted(words)


def _set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """As ``token_set_ratio``: what needs no subsequence pair by pair, the rest at once."""
    out, at, one, two = np.zeros(len(a)), [], [], []
    for i, ((x, p), (y, q)) in enumerate(zip(_each(_words, a), _each(_words, b), strict=True)):
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 100.0
            continue
        if both:
            head = [w for w in p if w in both]
            s1, s2 = " ".join(head + [w for w in p if w not in both]), " ".join(head + [w for w in q if w not in both])
            s = len(" ".join(head))
            out[i] = max(200.0 * s / (s + len(s1)), 200.0 * s / (s + len(s2)))
        else:
            s1, s2 = " ".join(p), " ".join(q)
        at.append(i)
        one.append(s1)
        two.append(s2)
    out[at] = np.maximum(out[at], _ratios(one, two))
    return out


def _partials(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lcs, partial ratio)"""
    length, best = best_windows(a, b, partial_ratio, lcs)
    return length, np.array([x if p and q else 0.0 if p or q else 100.0 for p, q, x in zip(a, b, best, strict=True)])


def _shares(a: list[str], b: list[str], length: np.ndarray | None = None) -> np.ndarray:
    length = lcs_many(a, b, lcs) if length is None else length
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    return np.where(size > 0, length / np.maximum(size, 1), 1.0)


def _winklers(a: list[str], b: list[str]) -> np.ndarray:
    j = jaro_many(a, b, jaro)
    same = np.zeros(len(a), dtype=np.int64)
    for i, x, y in ((i, a[i], b[i]) for i in np.flatnonzero(j > 0.7)):
        while same[i] < min(4, len(x), len(y)) and x[same[i]] == y[same[i]]:
            same[i] += 1
    raised = np.where(j > 0.7, j + 0.1 * same * (1 - j), j)
    return np.where([not x and not y for x, y in zip(a, b, strict=True)], 1.0, raised)


def _udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f([x or "" for x in a], [x or "" for x in b]), dtype="float64")

    return run


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf, lcs_share_udf = map(_udf, (_ratios, _sorted_ratios, _set_ratios, lambda a, b: _partials(a, b)[1], _winklers, _shares))

#: What ``family`` gives.
FAMILY = [
    *(f"{x}_{y}" for x in ("name", "addr") for y in ("ratio", "partial", "tsort", "tset")),
    *("core_ratio", "core_tset", "sq_ratio", "sq_partial", "sq_jw", "sq_lcs", "phon_ratio", "num_tset"),
]


def _family(name: tuple, addr: tuple, core: tuple, sq: tuple, num: tuple) -> dict[str, np.ndarray]:
    """``FAMILY`` of texts, each a list of first and a list of second ones; a ratio and a partial ratio share what is computed
    for them."""
    out = {}
    for key, (a, b) in (("name", name), ("addr", addr)):
        length, best = _partials(a, b)
        out |= {f"{key}_ratio": _ratios(a, b, length), f"{key}_partial": best, f"{key}_tsort": _sorted_ratios(a, b), f"{key}_tset": _set_ratios(a, b)}
    length, best = _partials(*sq)
    out |= {"core_ratio": _ratios(*core), "core_tset": _set_ratios(*core), "sq_ratio": _ratios(*sq, length), "sq_partial": best, "sq_jw": _winklers(*sq), "sq_lcs": _shares(*sq, length)}
    return out | {"phon_ratio": _ratios(*[_each(_code, s) for s in core]), "num_tset": _set_ratios(*num)}


def _plain(*texts: pd.Series) -> tuple[list[str], ...]:
    return tuple([t or "" for t in s] for s in texts)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in FAMILY]))
def family(name_a: pd.Series, name_b: pd.Series, addr_a: pd.Series, addr_b: pd.Series, core_a: pd.Series, core_b: pd.Series, sq_a: pd.Series, sq_b: pd.Series, num_a: pd.Series, num_b: pd.Series) -> pd.DataFrame:
    """All ratios of pairs of records."""
    return pd.DataFrame(_family(_plain(name_a, name_b), _plain(addr_a, addr_b), _plain(core_a, core_b), _plain(sq_a, sq_b), _plain(num_a, num_b)))[FAMILY]


#: What ``_rarities`` tells of the words of two texts.
RARITY = ["shared_sum", "shared_max", "cov_a", "cov_b", "miss_max_a", "miss_max_b"]


def _weighed(texts: list[str], weights: pd.Series) -> list[tuple]:
    """(words to weights in the order of the words, weights' sum, words by falling weight) of each text. ``weights``: those of its
    distinct words, by word; none without a word."""
    known = {}
    for t, w in zip(texts, weights, strict=True):
        if t not in known:
            own = dict(zip(sorted(set(t.split(" "))), w.tolist(), strict=True)) if t else {}
            total = 0.0
            for x in own.values():
                total += x
            known[t] = own, total, sorted(own, key=own.get, reverse=True)
    return [known[t] for t in texts]


def _rarities(a: list[str], b: list[str], weights_a: pd.Series, weights_b: pd.Series) -> tuple[np.ndarray, ...]:
    """(words shared, words of the first, of the second, then ``RARITY``: sum and largest weight of the shared, their share of
    either side, 1 if that side is empty, and the largest missing of either side)"""
    out = np.zeros((len(a), 9))
    for i, ((x, of_x, by_x), (y, of_y, by_y)) in enumerate(zip(_weighed(a, weights_a), _weighed(b, weights_b), strict=True)):
        both = [w for k, w in x.items() if k in y]
        total = 0.0
        for w in both:
            total += w
        miss_x, miss_y = (next((m[k] for k in by if k not in n), 0.0) for m, by, n in ((x, by_x, y), (y, by_y, x)))
        out[i] = len(both), len(x), len(y), total, max(both, default=0.0), total / of_x if of_x else 1.0, total / of_y if of_y else 1.0, miss_x, miss_y
    return tuple(out.T)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _initials(text: str) -> str | None:
    """The words' first letters; None with fewer than two different words."""
    words = text.split(" ")
    return "".join(w[:1] for w in words) if len(set(words)) >= 2 else None


#: What ``meeting`` gives besides ``FAMILY``, and its whole numbers.
WORDS = ["core_jacc", "core_contain", "addr_jacc", *(f"{c}_{x}" for c in ("addr", "core") for x in RARITY)]
WHOLE = ["sq_prefix", "acronym"]


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in [*FAMILY, *WORDS]] + [StructField(c, IntegerType()) for c in WHOLE]))
def meeting(name_a: pd.Series, name_b: pd.Series, addr_a: pd.Series, addr_b: pd.Series, core_a: pd.Series, core_b: pd.Series, num_a: pd.Series, num_b: pd.Series, w_addr_a: pd.Series, w_addr_b: pd.Series, w_core_a: pd.Series, w_core_b: pd.Series) -> pd.DataFrame:
    """All ratios of pairs of records and what their words share; texts are words with a blank between."""
    addr, core = _plain(addr_a, addr_b), _plain(core_a, core_b)
    sq = tuple([t.replace(" ", "") for t in s] for s in core)
    out = _family(_plain(name_a, name_b), addr, core, sq, _plain(num_a, num_b))
    for column, texts, weights in (("addr", addr, (w_addr_a, w_addr_b)), ("core", core, (w_core_a, w_core_b))):
        shared, one, two, *rest = _rarities(*texts, *weights)
        out |= {f"{column}_jacc": shared / np.maximum(one + two - shared, 1), f"{column}_contain": shared / np.maximum(np.minimum(one, two), 1)}
        out |= {f"{column}_{x}": v for x, v in zip(RARITY, rest, strict=True)}
    out["sq_prefix"] = np.fromiter(map(_prefix, *sq), dtype=np.int32, count=len(sq[0]))
    initials = [_each(_initials, s) for s in core]
    out["acronym"] = np.array([p == y or q == x for p, q, x, y in zip(*initials, *sq, strict=True)], dtype=np.int32)
    return pd.DataFrame(out)[[*FAMILY, *WORDS, *WHOLE]]


_VOWELS = "AEIOU"


def metaphone(word: str) -> str:
    """Lawrence Philips' 1990 rules, letters only."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    for i, c in enumerate(w):
        prev, nxt, nxt2 = w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == prev and c != "C":
            continue
        if c in _VOWELS:
            out.append(c if i == 0 else "")
        elif c == "B":
            out.append("" if prev == "M" and not nxt else "B")
        elif c == "C":
            if nxt and nxt in "IEY":
                out.append("X" if nxt == "I" and nxt2 == "A" else "" if prev == "S" else "S")
            else:
                out.append("X" if nxt == "H" and prev != "S" else "K")
        elif c == "D":
            out.append("J" if nxt == "G" and nxt2 and nxt2 in "EIY" else "T")
        elif c == "G":
            if nxt == "H":
                out.append("K" if not nxt2 or nxt2 in _VOWELS else "")
            elif nxt == "N" and (not nxt2 or w[i + 1 :] == "NED"):
                out.append("")
            elif prev == "D" and nxt and nxt in "EIY":
                out.append("")
            else:
                out.append("J" if nxt and nxt in "IEY" and prev != "G" else "K")
        elif c == "H":
            out.append("" if (prev and prev in "CSPTG") or not (nxt and nxt in _VOWELS) else "H")
        elif c == "K":
            out.append("" if prev == "C" else "K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
        elif c == "S":
            out.append("X" if nxt == "H" or (nxt == "I" and nxt2 and nxt2 in "OA") else "S")
        elif c == "T":
            if nxt == "I" and nxt2 and nxt2 in "OA":
                out.append("X")
            elif nxt == "H":
                out.append("0")
            else:
                out.append("" if nxt == "C" and nxt2 == "H" else "T")
        elif c in "WY":
            out.append(c if nxt and nxt in _VOWELS else "")
        elif c == "X":
            out.append("KS")
        else:
            out.append({"Q": "K", "V": "F", "Z": "S"}.get(c, c))
    return "".join(out)


@functools.lru_cache(maxsize=1 << 16)
def _sound(word: str) -> str:
    return metaphone(word)


def _code(words: str) -> str:
    return " ".join(_sound(w) for w in words.split()[:2])


@F.pandas_udf(StringType())
def phonetic(words: pd.Series) -> pd.Series:
    """Codes of the first two words of a name, with a blank between."""
    return words.map(lambda x: _code(x or ""))
