import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def waterfill(sizes, weights, most=3):
    target, free, left = {}, dict(weights), float(sum(sizes.values()))
    while True:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > most * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    docs = []
    for j, n in enumerate((400, 3, 60, 10, 150, 1)):
        source = None if j == 5 else f"s{j}"
        docs += [(len(docs) + i, source, rng.randint(0, 30)) for i in range(n)]
    docs.append((10_000, "s0", 0))
    df = spark.createDataFrame([(*r, 7.0) for r in docs], "doc_id long, source string, size long, target double")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want = waterfill(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))})
    for s, n in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(want[s], abs=1e-5) and r.source_size == n for r in own)
        epochs = int(want[s] // n) if n else 0
        assert all(epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 16
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_words_edges_and_quality(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "a b c\n d"), (5, "x " * 5000)], "doc_id long, text string")
    assert [r.n for r in df.orderBy("doc_id").select(mixing.words_of(F.col("text")).alias("n")).collect()] == [0, 0, 0, 3, 5000]
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(1).cast("long").alias("size"))
    rows = mixing.mix(docs, F.when(F.col("doc_id") % 4 == 0, 4.0).otherwise(1.0)).where("source = 'a'").groupBy((F.col("doc_id") % 4 == 0).alias("good")).agg(F.avg("taken").alias("n")).collect()
    taken = {r.good: r.n for r in rows}
    assert taken[True] > taken[False] + 0.2


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).collect() == []
