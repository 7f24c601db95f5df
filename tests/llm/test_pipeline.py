"""The five stages on a small table with nulls, empty texts, copies and repeated rows."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = "the and of that with for this from".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(n))
    shared, long = text(12), text(80)
    near = long.replace(long.split()[40], "other", 1)
    rows = [(1, long), (2, long), (3, near), (4, f"{shared}\n{text(30)}"), (5, f"{shared}\n{text(30)}"), (6, None), (7, ""), (8, "12 34"), (9, text(40)), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(at.collect())
        assert k == 4 or at.columns == docs.columns
    ids = [sorted(r.doc_id for r in rows) for rows in kept]
    assert ids[0] == [1, 2, 3, 4, 5, 9]  # without a letter: gone
    assert ids[1] == [1, 3, 4, 5, 9]  # 2 lost its only line
    assert shared in next(r.text for r in kept[1] if r.doc_id == 4) and shared not in next(r.text for r in kept[1] if r.doc_id == 5)
    assert ids[2] == [1, 4, 5, 9]  # 3 is a near copy of 1
    assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 3 for i in ids[3])
    assert ids[4] == ids[3] and all(r.n_tokens == len(r.ids) > 0 for r in kept[4])
