import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice((s[:i] + s[i + 1 :], s[:i] + rng.choice("abé𝄞") + s[i:], s[:i] + rng.choice("abé𝄞") + s[i + 1 :]))
    return s


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance_is_exact_within_tau(spark, tau):
    rng = random.Random(tau)
    pairs = []
    while len(pairs) < 150:
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(6, 14)))
        b = edited(rng, a, rng.randint(0, tau + 2))
        if abs(len(a) - len(b)) <= tau and len(b) > tau:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("d", linededup.banded_distance(F.col("a"), F.col("b"), tau)).collect():
        true = distance(r.a, r.b)
        assert (r.d == true) if true <= tau else (r.d > tau), (r.a, r.b, r.d, true)


@pytest.mark.parametrize("tau", [1, 2])
def test_common_ends_leave_the_distance(spark, tau):
    rng = random.Random(3)
    pairs = []
    for _ in range(120):
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(6, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 3))))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) > tau] + [("x" * 300 + "ab" + "y" * 200, "x" * 300 + "b" + "y" * 200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rest = linededup.without_common_ends(F.col("a"), F.col("b"), tau)[0]
    for r in df.withColumn("x", rest["a"]).withColumn("y", rest["b"]).withColumn("near", linededup.within(F.col("a"), F.col("b"), tau)).collect():
        assert r.near == (distance(r.a, r.b) <= tau)
        assert distance(r.x, r.y) == distance(r.a, r.b) and min(len(r.x), len(r.y)) > tau
    assert len(r.x) < 12


def test_crowded_segments_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    head, tail = ("".join(rng.choice("abcdé") for _ in range(20)) for _ in range(2))
    docs = [(k, (head + edited(rng, tail, rng.choice((0, 1, 2)))) if k % 2 else edited(rng, head, rng.choice((0, 1, 2))) + tail) for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 1, 30)
    for crowd in (0, 4, 1000):
        monkeypatch.setattr(linededup, "CROWD", crowd)
        out = {r.doc_id: r.dropped for r in linededup.dedup(df).collect()}
        assert {k: v for k, v in out.items() if v} == want, crowd


def brute(docs, tau, least):
    lines = sorted((k, i, x) for k, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= least)
    drop, firsts = {}, {}
    for n, (k, i, x) in enumerate(lines):
        first = firsts.setdefault(x, n)
        if any(y != x and firsts[y] < first and distance(x, y) <= tau for y in firsts if abs(len(x) - len(y)) <= tau) or first < n:
            drop.setdefault(k, []).append(i)
    return drop


@pytest.mark.parametrize("tau", [1, 2])
def test_dedup_against_brute_force(spark, tau):
    rng = random.Random(7 + tau)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 13))) for _ in range(25)]
    docs = []
    for k in range(60):
        own = [edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3))) if rng.random() < 0.7 else rng.choice(("", "ab", "é" * 9)) for _ in range(rng.randint(0, 5))]
        docs.append((k, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, base[0] * 500)]
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in docs], "doc_id long, text string, line string, n_lines int")
    out = {r.doc_id: r for r in linededup.dedup(df, tau=tau, least=8).collect()}
    want = brute(docs, tau, 8)
    assert len(out) == len(docs)
    for k, t in docs:
        assert out[k].dropped == want.get(k, []), k
        assert out[k].text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(k, [])))
    assert out[0].line == "x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(df).collect() == []


def test_edit_far_from_both_ends_of_a_long_line(spark):
    long = "".join(random.Random(9).choice("abcdé ") for _ in range(300_000))
    cases = [(long[:150_000], 4), (long, 150_000), (long[:262_144], 131_072)]
    docs = [(2 * k + j, x[:at] + "#" + x[at + 1 :] if j else x) for k, (x, at) in enumerate(cases) for j in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.dropped for r in linededup.dedup(df).collect()}
    assert out == {k: [0] * (k % 2) for k, _ in docs}


def test_short_lines_go_as_exact_repeats(spark):
    short = ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "12", "}"]
    docs = [(0, "\n".join(short) + "\n\n"), (1, "\n".join(["13", *short, "", "All rights reserved!"])), (2, "own words\n}\n")]
    out = {r.doc_id: (r.dropped, r.text) for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {0: ([], docs[0][1]), 1: ([1, 2, 3, 4, 6], "13\n"), 2: ([1], "own words\n")}


def test_more_edits_in_longer_lines(spark, monkeypatch):
    rng = random.Random(13)
    allowed = lambda n: 0 if n < 8 else 1 if n < 100 else 2 if n < 400 else 3
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    lines = []
    for base in (text(60), text(99), text(101), text(250), text(401), text(420)):
        lines += [base, *[edited(rng, base, rng.randint(0, 4)) for _ in range(9)]]
        at = len(base) // 2
        lines += [base[:at] + edited(rng, base[at : at + 12], rng.randint(1, 4)) + base[at + 12 :] for _ in range(9)]
    rng.shuffle(lines)
    want = {k for k, x in enumerate(lines) if any(distance(x, y) <= allowed(min(len(x), len(y))) for y in lines[:k] if abs(len(x) - len(y)) < 4)}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for crowd in (0, 16):
        monkeypatch.setattr(linededup, "CROWD", crowd)
        assert {r.doc_id for r in linededup.dedup(df).collect() if r.dropped} == want, crowd
