"""Operators of the subpackage on small tables, against brute force, other libraries or exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, graph, langid, topk, toxicity, urlfilter, warc


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_tiktoken_and_round_trips(codec):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    letters = " \n\t a'b  .12é漢\x1c\x85\xa0st'll𝄞"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, "".join(rng.choice("abcdef") for _ in range(30_000))]
    for t in texts:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t)
        assert codec.decode(ids).decode() == t


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Hello  world", 9), (1, "Hello  world", 9), (2, None, 9), (3, "x" * 100_000, 9)], "doc_id long, text string, n_tokens int")
    out = bpe.encode_column(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode_column(out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "Hello  world"), (1, "Hello  world"), (2, ""), (3, "x" * 100_000)]
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.n_tokens == len(r.ids) for r in back)


def test_language_profiles(spark):
    rng = random.Random(2)
    words = {"a": "the and of that with for".split(), "b": "der und die das nicht für".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate("ab" * 30)]
    df = spark.createDataFrame([*rows, (100, None, "a"), (101, "12 ..", "b"), (102, "", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.learn_profiles(df)).collect()}
    assert all(out[i][0] == k for i, _, k in rows)
    assert all(out[i] == ("und", 0.0) for i in (100, 101, 102))
    assert [r.lang_pred for r in langid.identify(df.limit(1), {}).collect()] == ["und"]
    assert langid.learn_profiles(df.where("false")) == {}


def test_out_of_place_distance():
    own, other = langid.profile("abab", 50), langid.profile("abba", 50)
    found = langid.Identifier({"x": other.tolist()}, 50)("abab")[1]
    ranks = {c: i for i, c in enumerate(other)}
    assert found == pytest.approx(1 - sum(min(abs(i - ranks[c]), 50) if c in ranks else 50 for i, c in enumerate(own)) / (50 * len(own)))


def test_crf_marginals_and_scores(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(300):
        t = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(("vile", "rotten")))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    made = toxicity.fit(texts, labels)
    assert set(made["words"]) == {"vile", "rotten"}
    tag = toxicity.Tagger(made)
    score, spans = tag("w1 w2, ROTTEN vile w3")
    assert score >= 0.7 and [(s["start"], s["end"]) for s in spans] == [(7, 18)]
    # marginals of all words against the sum over all labellings, with words of the lexicon at the ends, apart and side by side
    for ids in ([0, 1, 0, 0, 2, 0], [1], [0], [1, 2, 0, 0, 0, 1], [0, 0, 0], [2, 0, 1, 1, 0, 2]):
        mass, on = 0.0, np.zeros(len(ids))
        for y in range(1 << len(ids)):
            bits = [y >> k & 1 for k in range(len(ids))]
            w = np.prod([tag.emit[i] if b else 1.0 for i, b in zip(ids, bits, strict=True)]) * np.prod([tag.step[a][b] for a, b in zip(bits, bits[1:], strict=False)])
            mass += w
            on += w * np.array(bits)
        assert tag.marginals(ids) == pytest.approx(on / mass, rel=1e-6)
    df = spark.createDataFrame([(1, "a vile day"), (2, None), (3, ""), (4, "w1 " * 20_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(df, made).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    empty = toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(df, empty).collect()] == [0.0] * 4


def test_arc_versions_and_warc_round_trip(spark, tmp_path):
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"\r\n\r\nWARC/1.0\r\n\xff\x00"
    for version in (1, 2):
        data = warc.arc_block(version, "20200102030405") + warc.arc_record(version, "http://a b/", "20200102030405", content) + warc.arc_record(version, None, "20200102030405", b"")
        (h, c), (h2, c2) = warc.read_arc(data)
        assert (h["URL"], c, h2["URL"], c2) == ("http://a%20b/", content, "-", b"")
        ((head, block),) = warc.read_warc(iter([warc.convert(h, c) + b"\r\n\r\n"]))
        assert (head["WARC-Type"], head["WARC-Date"], block) == ("response", "2020-01-02T03:04:05Z", content)
        assert base64.b32decode(head["WARC-Payload-Digest"][5:]) == hashlib.sha1(content.split(b"\r\n\r\n", 1)[1]).digest()
        with pytest.raises(ValueError, match="truncated"):
            list(warc.read_arc(warc.arc_block(version, "20200102030405") + warc.arc_record(version, "u", "20200102030405", content)[:-9]))
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, small), (4, "c", small), (5, "d", None), (6, "e", "\r\n\r\nWARC/1.0\r\n" * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(warc.records(df, warc.first_copies(df)), str(tmp_path / "w"))
    out = {int(r.page): r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers) for k, r in out.items()} == {1: ("revisit", "2"), **{k: ("response", None) for k in range(2, 7)}}
    for k, _, html in rows:
        assert (out[k].payload_bytes, out[k].payload_digest) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2064)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_url_aliases(spark):
    link = '<LINK href="{}" rel="canonical">'
    rows = [
        (1, "http://x.foo/a", link.format("http://bad.net/z")),  # its target is blocked
        (2, "https://X.foo/a#q", "<p>"),  # the same resource
        (3, "http://y.foo/b", '<meta http-equiv="refresh" content="0; url=/c">'),
        (4, "http://y.foo/c", link.format("//s.example.net/en/1") + '<meta http-equiv=refresh content="0;url=http://bad.net/">'),  # allow goes first
        (5, "http://z.foo/", None), (6, None, "<p>"), (7, "nothing", link.format("http://bad.net/")), (8, "http://A.NET", ""), (9, "http://a.net/?x", ""), (10, "http://q.org/fr/1?u=://b", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert {k: v[3] for k, v in out.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert out[8][:3] == ("a.net", "", None) and out[9][:3] == ("a.net", "/", "net/") and out[10][2] == "org/fr/" and out[6][:3] == ("", "", None)


@pytest.mark.parametrize("scale", [1, 2**22])
def test_top_k_against_brute_force(spark, scale, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (400, 8)) * scale // 8
    x[:50] *= 3
    x[7] = x[3]
    x[11] = 0
    df = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "BLOCK", 16)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 7, 2, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 5):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[i], strict=True)), i) for i in range(400) if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_top_k_by_coordinate_and_few_rows(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-60, 60, (5, 16))
    x = np.concatenate([base + rng.integers(-3, 4, (5, 16)) for _ in range(60)])
    df = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()}
    for q in range(0, 300, 10):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [i for _, i in want]
    assert topk.top_k(df.limit(1), F.lit(True)).count() == 0
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    odd = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), ([],), (None,), ([1.0],)], "e array<float>")
    assert [r.u for r in odd.select(topk.usable(F.col("e")).alias("u")).collect()] == [False] * 5 + [True]


def test_fingerprints_recover_differences(spark):
    rng = random.Random(8)
    docs = [(i, "\n".join(f"line {rng.randrange(30)}" for _ in range(rng.randint(0, 25)))) for i in range(40)] + [(50, None), (51, ""), (52, "one"), (53, "\n".join(map(str, range(600))))]
    docs.append((60, docs[3][1]))
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, next string")
    out = {r.doc_id: r for r in fingerprint.edited_pairs(df, 4).collect()}
    assert len(out) == len(docs)

    def bag(t):
        seen, found = {}, set()
        for line in (t or "").split("\n"):
            if line:
                seen[line] = seen.get(line, 0) + 1
                found.add((line, seen[line]))
        return found

    for n, (k, t) in enumerate(docs):
        t, other = t or "", docs[(n + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        for near, x in ((out[k].near_edited, edited), (out[k].near_next, other)):
            a, b = bag(t), bag(x)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert out[k].n_chars == len(t) and out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert out[3].fingerprint == out[60].fingerprint and out[50].fingerprint == out[51].fingerprint
    assert fingerprint.edited_pairs(df.where("false"), 4).collect() == []
