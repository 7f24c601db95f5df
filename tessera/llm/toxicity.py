"""Toxic spans by a linear-chain conditional random field.

States are O and T. Only document labels exist, so tokens are labelled from them: in a toxic document, a word whose
document counts differ between toxic and other documents beyond chance (G-squared) is T, all else is O. The field is
trained on those tokens; scoring is exact forward-backward over the whole text, in which a run of words outside the
lexicon is one power of the neutral transfer matrix. Marginals of T give spans; a document's score is the noisy-or of
its tokens' marginals, so one certain span suffices and length alone does not.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import worker
from tessera.llm.skew import least_hashed
from tessera.session import materialize

#: The field is fitted on so many labelled documents of each label at most: those whose id has the least hash.
DOCS_PER_LABEL = 1500
#: G-squared and documents from which a word is evidence; words of a lexicon at most.
LEAST_G2, LEAST_DOCS, LEXICON = 25.0, 5, 2000
#: A token whose marginal is SPAN_AT or more is part of a span; a document of score THRESHOLD or more counts as toxic.
SPAN_AT, THRESHOLD = 0.5, 0.7
SEGMENT, STEPS, RATE, DECAY = 64, 200, 0.1, 1e-3
WORD = re.compile(r"[^\W_]+")


def lexicon(texts: list[list[str]], labels: list[int]) -> list[str]:
    """Words with more documents among the toxic ones than chance gives. Documents that repeat one passage say it once: a
    word counts as many toxic documents at most as it has different pairs of neighbours there."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    with_word = [Counter(w for t, y in zip(texts, labels, strict=True) if y == k for w in set(t)) for k in (0, 1)]
    often = {w for w, a in with_word[1].items() if a >= LEAST_DOCS and n0 and a / n1 > with_word[0][w] / n0}
    beside: dict[str, set] = {w: set() for w in often}
    for t, y in zip(texts, labels, strict=True):
        if y:
            for before, w, after in zip(["", *t], t, [*t[1:], ""], strict=False):
                if w in often:
                    beside[w].add((before, after))
    found = []
    for w in often:
        a, b = min(with_word[1][w], len(beside[w])), with_word[0][w]
        if a >= LEAST_DOCS and a / n1 > b / n0:
            share = (a + b) / (n0 + n1)
            cells = ((a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share)))
            g2 = 2 * sum(x * np.log(x / e) for x, e in cells if x > 0)
            if g2 >= LEAST_G2:
                found.append((-g2, w))
    return [w for _, w in sorted(found)[:LEXICON]]


def fit(texts: list[str], labels: list[int]) -> dict:
    """Emission of T against O for each word of the lexicon and for all others, and transitions; by gradient ascent on the
    penalised likelihood of the labelled tokens, in segments of SEGMENT tokens (equal ones count once, weighted)."""
    tokens = [[w.lower() for w in WORD.findall(t or "")] for t in texts]
    words = lexicon(tokens, labels)
    ids = {w: i + 1 for i, w in enumerate(words)}
    segments: Counter = Counter()
    for t, y in zip(tokens, labels, strict=True):
        x = [ids.get(w, 0) for w in t]
        for i in range(0, len(x), SEGMENT):
            segments[tuple(x[i : i + SEGMENT]), y] += 1
    emit, trans = np.zeros(len(words) + 1), np.zeros((2, 2))
    if not words:
        return {"words": [], "emit": [-20.0], "trans": trans.tolist()}
    n = len(segments)
    x, y, live = np.zeros((n, SEGMENT), dtype=int), np.zeros((n, SEGMENT), dtype=int), np.zeros((n, SEGMENT), dtype=bool)
    weight = np.array(list(segments.values()), dtype=float)
    for r, (s, label) in enumerate(segments):
        x[r, : len(s)], live[r, : len(s)] = s, True
        y[r, : len(s)] = [int(label and w > 0) for w in s]
    theta, m, v = np.concatenate((emit, trans.ravel())), 0.0, 0.0
    both = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), np.repeat(weight, SEGMENT - 1).reshape(n, -1)[both])
    spread = np.repeat(weight, SEGMENT).reshape(n, -1)
    seen_emit = np.bincount(x[live], (spread * y)[live], len(emit))
    total = float((weight * live.sum(axis=1)).sum())
    for step in range(1, STEPS + 1):
        emit, trans = theta[: len(emit)], theta[len(emit) :].reshape(2, 2)
        e = np.stack((np.zeros_like(x, dtype=float), emit[x]), axis=2)
        a = np.zeros((n, SEGMENT, 2))
        b = np.zeros((n, SEGMENT, 2))
        a[:, 0] = e[:, 0]
        for t in range(1, SEGMENT):
            a[:, t] = np.where(live[:, t, None], np.logaddexp(a[:, t - 1, :1] + trans[0], a[:, t - 1, 1:] + trans[1]) + e[:, t], a[:, t - 1])
        for t in range(SEGMENT - 2, -1, -1):
            nxt = b[:, t + 1] + e[:, t + 1]
            b[:, t] = np.where(live[:, t + 1, None], np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:]), b[:, t + 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None])[:, :, 1] * live
        pair = np.exp(a[:, :-1, :, None] + trans + (b + e)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate((seen_emit - np.bincount(x[live], (spread * p)[live], len(emit)), (seen - (pair * weight[:, None, None, None]).sum(axis=(0, 1))).ravel())) - DECAY * total * theta / len(theta)
        grad /= max(1.0, total / SEGMENT)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"words": words, "emit": theta[: len(emit)].tolist(), "trans": theta[len(emit) :].reshape(2, 2).tolist()}


class Tagger:
    def __init__(self, model: dict):
        self.ids = {w: i + 1 for i, w in enumerate(model["words"])}
        self.step = np.exp(np.array(model["trans"]))
        self.emit = np.exp(np.minimum(np.array(model["emit"]), 50.0))
        neutral = self.step * np.array([1.0, self.emit[0]])
        (a, b), (c, d) = neutral
        root = float(np.sqrt((a - d) ** 2 + 4 * b * c))
        self.high, low = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = low / self.high
        # neutral^n / high^n = project + ratio^n * (identity - project)
        self.project = (neutral - low * np.eye(2)) / max(root, 1e-12)
        self.rest = np.eye(2) - self.project
        self.known = np.ones(1)
        # log(1 - P(T)) of a word in the midst of an endless text without words of the lexicon
        far = np.ones(2) @ self.project * (self.project @ np.ones(2))
        self.plain = float(np.log1p(-min(far[1] / far.sum(), 1 - 1e-12)))

    def run(self, n: int) -> np.ndarray:
        """n neutral steps, up to a factor."""
        return self.project + self.ratio**n * self.rest

    def powers(self, n: int) -> np.ndarray:
        """ratio ** 0 to n - 1."""
        if len(self.known) < n:
            self.known = self.ratio ** np.arange(max(n, 2 * len(self.known)))
        return self.known[:n]

    def marginals(self, ids: list[int]) -> np.ndarray:
        """P(T) of every word, by forward-backward. Between two words of the lexicon the messages are powers of the neutral
        transfer matrix, which are known in closed form, so a run of them is one array operation."""
        n = len(ids)
        hits = [i for i, k in enumerate(ids) if k]
        steps = {k: self.step * np.array([1.0, self.emit[k]]) for k in {ids[i] for i in hits}}
        out = np.empty(n)
        ends = [-1, *hits, n]  # runs lie between
        # after[j]: message into the last word of run j from what follows; ones at the end
        after: list[np.ndarray] = [np.ones(2)] * len(ends)
        for j in range(len(ends) - 2, 0, -1):
            beyond = self.run(ends[j + 1] - ends[j] - 1) @ after[j]
            after[j - 1] = steps[ids[ends[j]]] @ (beyond / beyond.sum())
        ahead = None  # forward message of the last hit
        for j in range(len(ends) - 1):
            start, length = ends[j] + 1, ends[j + 1] - ends[j] - 1
            if length:
                if ahead is None:  # the first word has no transition before it
                    first, shift = np.array([1.0, self.emit[0]]), 0
                else:
                    first, shift = ahead, 1
                r = self.powers(length + 1)
                f = np.outer(np.ones(length), first @ self.project) + np.outer(r[shift : length + shift], first @ self.rest)
                b = np.outer(np.ones(length), self.project @ after[j]) + np.outer(r[:length][::-1], self.rest @ after[j])
                p = f * b
                out[start : start + length] = p[:, 1] / p.sum(axis=1)
            if j + 1 < len(ends) - 1:
                k = ids[ends[j + 1]]
                if ahead is None and not length:
                    now = np.array([1.0, self.emit[k]])
                else:
                    before = np.array([1.0, self.emit[0]]) @ self.run(length - 1) if ahead is None else ahead @ self.run(length)
                    now = before @ steps[k]
                ahead = now / now.sum()
                back = self.run(ends[j + 2] - ends[j + 1] - 1) @ after[j + 1]
                p = ahead * back
                out[ends[j + 1]] = p[1] / p.sum()
        return np.clip(out, 0.0, 1.0)

    def __call__(self, text: str | None) -> tuple[float, list[dict]]:
        """Score and spans (code point offsets, end exclusive, largest marginal)."""
        words = WORD.findall(text or "")
        if not words or not self.ids:  # a model that has learned no word tells nothing
            return 0.0, []
        get = self.ids.get
        p = self.marginals([get(w, 0) for w in map(str.lower, words)])
        score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() - len(p) * self.plain))
        sure = np.flatnonzero(p >= SPAN_AT)
        spans: list[dict] = []
        if len(sure):
            found = list(WORD.finditer(text))
            before = None
            for i in sure.tolist():
                q = float(p[i])
                if before == i - 1:
                    spans[-1] |= {"end": found[i].end(), "p": max(spans[-1]["p"], q)}
                else:
                    spans.append({"start": found[i].start(), "end": found[i].end(), "p": q})
                before = i
        return min(1.0, max(0.0, score)), spans


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> dict:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1), fitted in one task on a bounded sample:
    ``per_label`` labelled ids of each label, of least hash, and of an id that repeats the least text. Ids are picked from
    the labels alone, and texts fetched by a join with that short list, so other texts never move. Null labels and ids are
    left out; with one label only, or without any text, nothing is toxic."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picked = materialize(least_hashed(known, "toxic", "doc_id", per_label), "picked")  # written, so that Spark knows its size
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")  # 2 per_label rows at most

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].tolist()
            labels += batch["toxic"].tolist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", labels[i]))  # as rows arrive in any order
        yield pd.DataFrame({"model": [json.dumps(fit([texts[i] for i in order], [labels[i] for i in order]))]})

    rows = sample.repartition(1).mapInPandas(fitted, "model string").collect()
    return json.loads(rows[0].model) if rows else fit([], [])


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``spans`` (start, end, p) and ``predicted``; columns of these names are replaced. Null and
    empty texts score 0. Row by row, without a shuffle."""
    of = _Lazy(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        worker.use("toxicity")
        return pd.DataFrame([of(t) for t in texts], columns=["score", "spans"])

    out = docs.drop("score", "spans", "predicted").withColumn("__tox", scored(F.col(text))).select("*", "__tox.score", "__tox.spans").drop("__tox")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


class _Lazy:
    """Ships the model and builds the tagger on first use."""

    def __init__(self, model):
        self.model, self.made = model, None

    def __getstate__(self):
        return (self.model, None)

    def __setstate__(self, state):
        self.model, self.made = state

    def __call__(self, text):
        if self.made is None:
            self.made = Tagger(self.model)
        return self.made(text)
