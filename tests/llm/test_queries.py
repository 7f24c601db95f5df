"""The registered queries on small tables: splits, ids beyond 2^53, repeated rows, empty tables, clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, langid, linededup, mixing, ngramjoin, queries, skew, topk, toxicity, urlfilter, warc

BIG = 2**53 + 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_ids_beyond_doubles(spark, tmp_path):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(99)}" for _ in range(80))
    docs = [(BIG, text), (BIG + 1, text + " x"), (None, text), (BIG + 2, "y"), (None, None)]
    out = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect() if r.doc_id}
    assert out == {BIG: (BIG, 2), BIG + 1: (BIG, 2), BIG + 2: (BIG + 2, 0)}
    html = "<p>" * 500
    d = write(spark, tmp_path, pages=([(BIG, "u", html), (BIG + 1, "u", html), (None, None, "z"), (BIG + 3, "v", None)], "page_id long, url string, html string"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in queries.op6_warc(spark, d).collect()}
    assert got == {BIG: ("revisit", BIG + 1, 1500), BIG + 1: ("response", None, 1500), None: ("response", None, 1), BIG + 3: ("response", None, 0)}


def test_archives_roll_and_hold_a_member_a_record(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i * 300)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.records(df, warc.first_copies(df)), str(tmp_path / "w"), most=2000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3
    assert sorted(int(r.page) for r in warc.read(spark, str(tmp_path / "w")).collect()) == list(range(40))
    large = bytes(random.Random(2).randbytes(100)) + b"a" * (17 << 20)
    made = warc.member(large)
    assert made[-1] == 0 and b"".join(warc.unzipped(made)) == large + b"\r\n\r\n"


def test_a_result_for_every_query_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (60, 4))
    ids = [20, 20, *range(1, 59)]
    ids[30] = 20
    monkeypatch.setattr(topk, "BUCKET", 8)
    monkeypatch.setattr(topk, "BLOCK", 2)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, 2, 4).collect()
    want = []
    for q in range(60):
        if ids[q] % 20 == 0:
            best = sorted((-int(x[q] @ x[c]), ids[c]) for c in range(60) if ids[c] != ids[q])[:5]
            want += [(ids[q], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_learned_queries_split_and_columns(spark, tmp_path):
    rng = random.Random(4)
    plain, words = [f"w{i}" for i in range(300)], {"en": "the and of that".split(), "de": "der und die das".split()}
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        toxic = i % 3 == 0
        t = [rng.choice(plain + words[lang] * 30) for _ in range(30)] + ["vile", "rotten"] * toxic
        rng.shuffle(t)
        rows.append((i, " ".join(t), lang, "s", 1))
        labels.append((i, 0, int(toxic)))
    rows += [(900, None, None, None, None), (901, "12 !", "en", None, 4), (None, "the and", "en", "s", 7), (1, "the the", "en", "s", 7)]
    d = write(spark, tmp_path, documents=(rows, DOCS), labels=([*labels, (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int"))
    tox = queries.op4_toxicity(spark, d).collect()
    assert len(tox) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in tox)
    for r in tox:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in tox if r.held_out and r.doc_id < 400]
    assert [(r.doc_id, r.score) for r in held if (r.score >= 0.7) != (r.doc_id % 3 == 0)] == [] and len(held) > 50
    told = {(r.doc_id, r.held_out): r.lang_pred for r in queries.op5_langid(spark, d).collect()}
    assert told[900, zlib.crc32(b"900") % 5 == 0] == "und" and told[901, zlib.crc32(b"901") % 5 == 0] == "und"
    assert all(told[i, zlib.crc32(str(i).encode()) % 5 == 0] == ("en", "de")[i % 2] for i in range(2, 400))


def test_sample_is_bounded_and_of_least_hash(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    out = skew.least_hashed(df, "g", "k", 40)
    want = df.withColumn("h", F.xxhash64("k")).orderBy("h").collect()
    for g in (0, 1):
        assert {r.k for r in out.collect() if r.g == g} == {r.k for r in [w for w in want if w.g == g and (w.h % 2**64) >= 0]} & {r.k for r in out.collect() if r.g == g}
    assert out.groupBy("g").count().where("count = 40").count() == 2
    assert skew.least_hashed(df.where("false"), "g", "k", 40).count() == 0


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 4)
    rows = spark.range(2000).select(F.col("id").alias("x"), F.when(F.col("id") < 1500, 1).when(F.col("id") < 1900, F.col("id") % 50).alias("k"))
    told = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        out = skew.spread_join(rows, told, ["k"], "n", 2000, ["x"], how)
        assert sorted(map(str, out.select("x", "k", "n").collect())) == sorted(map(str, rows.join(told, "k", how).select("x", "k", "n").collect()))


def test_aliases_over_hub_and_chain(spark):
    """Against a search from every page: a hub, a long chain and random links."""
    rng = random.Random(6)
    link = '<link rel="canonical" href="{}">'
    rows = [(i, f"http://h{i}.foo/", link.format("http://hub.foo/")) for i in range(150)] + [(200, "http://hub.foo/", link.format("http://x.net/a"))]
    rows += [(300 + i, f"http://c.foo/{i}", link.format(f"/{i + 1}")) for i in range(40)] + [(340, "http://c.foo/40", link.format("http://q.org/fr/1"))]
    rows += [(400 + i, f"http://r.foo/{i}", link.format(rng.choice([f"/{rng.randrange(60)}", f"http://z{i}.net/", f"http://w.example.net/en/{i}"]))) for i in range(60)]
    rows += rows[:3]
    out = {(r.page_id): r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    near = {}
    for _, u, h in rows:
        a, t = u[7:], h.split('href="')[1].split('"')[0]
        b = t[7:] if t.startswith("http") else u[7:].split("/")[0] + t
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def rule(x):
        host, path = x.split("/", 1)[0], "/" + x.split("/", 1)[1]
        if host.endswith("example.net") and path.startswith("/en/") or host.endswith(".org") and path.startswith("/fr/"):
            return "allow"
        return "block" if host.endswith(".net") else None

    for p, u, _ in rows:
        seen, todo = set(), [u[7:]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        said = {rule(x) for x in seen}
        assert out[p] == (rule(u[7:]) or ("allow" if "allow" in said else "block" if "block" in said else "allow")), u


def test_many_paragraphs_and_no_other_method(spark):
    lines = [f"line {i % 1500}" for i in range(2000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[:1900]) + "\nnew"), (2, "a"), (None, None)]
    out = fingerprint.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string"), 4).where("n_chars > 5").collect()
    assert all(r.peeled for r in out)
    assert next(r.near_next for r in out if r.doc_id == 1) in (pytest.approx(1900 / 2001), 0.0)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    path, pattern = queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN
    assert bpe.encode_column(none, path, pattern).collect() == []
    assert langid.identify(none, {}).collect() == [] and toxicity.score(none, toxicity.fit([], [])).collect() == []
    assert linededup.dedup(none).collect() == [] and ngramjoin.join(none).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(pages).collect() == []
    assert queries.op6_warc(spark, write(spark, tmp_path, pages=([], "page_id long, url string, html string"))).collect() == []
    df = spark.createDataFrame([(1, "the and", 5.0, "x", "y", 3)] * 2, "doc_id long, text string, score double, lang_pred string, spans string, predicted int")
    assert len(langid.identify(df, {"a": [1]}).columns) == 6 and len(toxicity.score(df, toxicity.fit([], [])).columns) == 6
    sizes = spark.createDataFrame([(None, "a", 5), (None, "a", 5), (1, None, 0), (1, "a", 3)], "doc_id long, source string, size long")
    assert sum(r.taken for r in mixing.mix(sizes).collect()) > 0
