import random

import pytest

from tessera.llm import ngramjoin


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [grams(t) for _, t in docs]
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {docs[i][0]: (docs[root(i)][0], links[i]) for i in range(len(docs))}


@pytest.mark.parametrize("chunk", [256, 8])
def test_join_against_brute_force(spark, chunk):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    docs = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice((1, 1, 2, 3, 40 if g == 4 else 5))):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((len(docs), " ".join(t)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "Alone"), (904, "alone"), (905, " ".join(words) * 20)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, key string")
    out = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(df, chunk=chunk).collect()}
    assert out == brute(docs)


def test_bands_reach_the_recall():
    bands, rows = ngramjoin.bands_and_rows(0.8, 0.9995, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_empty_and_repeated_rows(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f")] * 2 + [(None, "a b c d e f"), (2, "x")]
    out = sorted(map(tuple, ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == [(1, 1, 2), (1, 1, 2), (2, 2, 0), (None, 1, 2)]
