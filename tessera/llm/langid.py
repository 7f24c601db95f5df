"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A profile is a list of the most frequent letter n-grams (one to three letters, words padded by a boundary mark), most
frequent first. A text is given the language whose profile is nearest to its own by the out-of-place distance: the sum
over the text's n-grams of how far the rank is from that in the language's profile, ``size`` where it is absent.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import worker
from tessera.llm.skew import least_hashed
from tessera.session import materialize

#: Length of a profile; documents of each language that a profile is learned from at most, those of least hash.
PROFILE_SIZE, DOCS_PER_LANG = 400, 400
UNKNOWN = "und"
#: A text whose score is not above this is as far from every profile as unrelated letters: random ones reach 0.22, letters of
#: documents in another order 0.35 in the median, and documents have 0.41 and more (0.1 % of them under 0.46), measured at sf0.1.
REJECT_AT = 0.3


@cache
def _letters() -> np.ndarray:
    """For each code point: 1 (the boundary) if it's no letter, else itself plus 1."""
    return np.fromiter((c + 1 if chr(c).isalpha() else 1 for c in range(sys.maxunicode + 1)), dtype=np.int64, count=sys.maxunicode + 1)


def ngrams(text: str) -> np.ndarray:
    """Codes of the n-grams of a whole text: 21 bits a letter, so that no two collide."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = _letters()[points]
    edge = x == 1
    x = x[np.concatenate(([True], ~(edge[1:] & edge[:-1])))]
    if len(x) < 3:
        return np.empty(0, dtype=np.int64)
    two, middle = (x[:-1] << 21) | x[1:], x[1:-1] > 1
    three = ((two[:-1] << 21) | x[2:])[middle]
    return np.concatenate((x[x > 1], two, three))


def profile(text: str, size: int = PROFILE_SIZE) -> np.ndarray:
    """The n-grams of most occurrences, ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE, per_lang: int = DOCS_PER_LANG) -> dict[str, list[int]]:
    """Profiles of every non-null ``lang`` of ``docs`` (doc_id, text, lang), each from ``per_lang`` documents at most:
    those whose id has the least hash. Ids are picked first, so that texts of other documents never move; what comes to
    the driver is ``size`` codes a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    picked = materialize(least_hashed(known, "lang", "doc_id", per_lang), "picked")  # written, so that Spark knows its size
    sample = known.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = defaultdict(list)
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found[lang].append(ngrams(text))
            for lang, parts in found.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n.astype("int64")})

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = sample.mapInPandas(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = defaultdict(list)
    for row in ranked.select("lang", "rank", "code").orderBy("lang", "rank").collect():
        out[row.lang].append(row.code)
    return dict(out)


class Identifier:
    """Ranks of all profiles side by side, for one look-up a text."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for x in profiles.values() for c in x], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the distance's share of the largest possible. Ties go to the first by name."""
        own = profile(text or "", self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced); null texts and texts without a
    letter are ``und`` with score 0, as is every text if no profile was learned. Row by row, without a shuffle."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        worker.use("langid", _letters.cache_clear)
        return pd.DataFrame([of(t) for t in texts], columns=["lang_pred", "score"])

    of = _Lazy(profiles, size)
    # else Spark moves a filter on the result below it, and a second worker a task tells every language again
    predicted = predicted.asNondeterministic()
    return docs.drop("lang_pred", "score").withColumn("__lang", predicted(F.col(text))).select("*", "__lang.lang_pred", "__lang.score").drop("__lang")


class _Lazy:
    """Ships the profiles and builds the tables on first use."""

    def __init__(self, profiles, size):
        self.profiles, self.size, self.made = profiles, size, None

    def __getstate__(self):
        return (self.profiles, self.size, None)

    def __setstate__(self, state):
        self.profiles, self.size, self.made = state

    def __call__(self, text):
        if self.made is None:
            self.made = Identifier(self.profiles, self.size)
        return self.made(text)
