"""Text normalisation and record signatures as columns; Python only where Unicode decomposition is needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values, which must be these for right results: Latin letters for the common layout of the Indic blocks, by the low
# seven bits of the code point, and the range of the consonants among them.
_LETTERS = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri",
    0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x15: "k",
    0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t",
    0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n",
    0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l",
    0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u",
    0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o",
    0x4C: "au", 0x4E: "t", 0x66: "0", 0x67: "1", 0x68: "2", 0x69: "3", 0x6A: "4", 0x6B: "5", 0x6C: "6", 0x6D: "7",
    0x6E: "8", 0x6F: "9", 0x70: "n", 0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k",
}
CONSONANTS = range(0x15, 0x3A)
# Top-level domains, the pattern of a domain name, and the patterns of a canonical text.
TLDS = ["www", "com", "net", "org", "in", "co", "fr", "biz", "info", "us", "io"]
DOMAIN = r"(?iU)^\s*(www\.)?[\w-]+\.(com|net|org|in|co|fr|biz|info|us|io)\b"
NOT_A_WORD = r"[^0-9a-z\s]"
BETWEEN_INITIALS = r"(?<=\b\w) (?=\w\b)"
_INDIC = re.compile("[\u0900-\u0D7F]+")


def romanise(text: str) -> str:
    """Indic letters in Latin ones; a consonant directly before another, or before a nasal sign, keeps its vowel."""

    def run(match: re.Match) -> str:
        low = [ord(c) & 0x7F for c in match[0]]
        tails = [*low[1:], None]
        return "".join(_LETTERS.get(c, "") + ("a" if c in CONSONANTS and (t in CONSONANTS or t in (1, 2, 3)) else "") for c, t in zip(low, tails, strict=True))

    return _INDIC.sub(run, text)


def _without_accents(text: str) -> str:
    return "".join(c for c in text if not "\u0300" <= c <= "\u036F")


def canon_text(text: str) -> str:
    """Lower-case ASCII words: accents off, Indic romanised, ``&`` spelled out, runs of single letters joined."""
    latin = _without_accents(romanise(unicodedata.normalize("NFKD", text)))
    ascii_only = unicodedata.normalize("NFKD", latin.lower().replace("&", " and ")).encode("ascii", "ignore").decode()
    words = re.sub(NOT_A_WORD, " ", ascii_only).split()
    return re.sub(BETWEEN_INITIALS, "", " ".join(words))


@F.pandas_udf(StringType())
def canon(column: pd.Series) -> pd.Series:
    return column.map(lambda x: canon_text(x or ""))


@F.pandas_udf(StringType())
def romanised(column: pd.Series) -> pd.Series:
    return column.map(lambda x: romanise(x or ""))


def ascii_tokens(text: Column) -> Column:
    """The words of a text, as ``canon`` gives them for plain ASCII but without joining initials."""
    return tokens(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " ")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def numbers(text: Column) -> Column:
    """Runs of digits without leading zeros, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", "")))


def alpha_words(words: Column) -> Column:
    return F.filter(words, lambda x: x.rlike("^[a-z]+$") & (F.length(x) > 1))


def is_domain(text: Column) -> Column:
    return F.coalesce(text.rlike(DOMAIN), F.lit(False))


def has_indic(text: Column) -> Column:
    return F.coalesce(text.rlike("[\u0900-\u0D7F]"), F.lit(False))


def without(words: Column, unwanted: list[str]) -> Column:
    """Words but the unwanted ones; all of them if none would be left."""
    kept = F.filter(words, lambda x: ~x.isin(unwanted)) if unwanted else words
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def suffixes(words: Column, legal: list[str]) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.filter(words, lambda x: x.isin(legal)))), " ") if legal else F.lit("")


def mapped(words: Column, names: dict[str, str]) -> Column:
    """Each word's replacement, itself if it has none."""
    if not names:
        return words
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.transform(words, lambda x: F.coalesce(F.element_at(table, x), x))


def merged_pairs(words: Column, longs: list[str]) -> Column:
    """Left to right, two neighbours become one word where that is among ``longs``."""
    if not longs:
        return words

    def step(out: Column, w: Column) -> Column:
        last = F.element_at(out, -1)["w"]
        joins = (F.size(out) > 0) & ~F.element_at(out, -1)["joined"] & F.concat(last, w).isin(longs)
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.concat(last, w).alias("w"), F.lit(True).alias("joined"))))).otherwise(
            F.concat(out, F.array(F.struct(w.alias("w"), F.lit(False).alias("joined"))))
        )

    start = F.array().cast("array<struct<w:string,joined:boolean>>")
    safe = lambda out, w: F.when(F.size(out) == 0, F.array(F.struct(w.alias("w"), F.lit(False).alias("joined")))).otherwise(step(out, w))
    return F.transform(F.aggregate(words, start, safe), lambda x: x["w"])


def subsequence(short: Column, long: Column) -> Column:
    """Same first letter, and the rest of ``short`` in order within ``long``."""
    return (F.left(short, F.lit(1)) == F.left(long, F.lit(1))) & F.call_function("rlike", long, F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*")))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))
