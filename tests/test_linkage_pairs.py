"""Features of pairs: many at once as one at a time, and each pair moved once."""

import random

from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import alignment as A
from tessera.functions import similarity as S
from tessera.operators import blocking, features
from tessera.plans import link
from tessera.session import materialize, settle


def _texts(rng, n):
    words = ["alpha", "beta", "street", "of", "the", "x", "1", "ü", "north", "\U0001f600"]
    own = lambda: "ab" * rng.randint(150, 250) if rng.random() < 0.01 else " ".join(rng.choices(words, k=rng.randint(0, 9)))
    return [own() for _ in range(n)]


def test_ratios_of_many_pairs_equal_single_ones():
    rng = random.Random(5)
    for n in (3, 1500):
        a, b = _texts(rng, n), _texts(rng, n)
        of = lambda f: [f(x, y) for x, y in zip(a, b, strict=True)]  # noqa: E731, B023
        assert S._ratios(a, b).tolist() == of(S.ratio) and S._sorted_ratios(a, b).tolist() == of(S.token_sort_ratio)
        assert S._set_ratios(a, b).tolist() == of(S.token_set_ratio) and S._shares(a, b).tolist() == of(S.lcs_share)
        length, best = S._partials(a, b)
        assert best.tolist() == of(S.partial_ratio) and length.tolist() == of(S.lcs)


def test_jaro_winkler_of_many_pairs_equals_single_ones():
    rng = random.Random(7)
    a = [x[: rng.randint(0, 40)] for x in _texts(rng, 1500)]
    b = [x if rng.random() < 0.1 else x[::-1] for x in a[:700]] + _texts(rng, 800)
    assert S._winklers(a, b).tolist() == [S.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]


def test_a_pair_s_words_are_weighed_in_the_pass_of_its_ratios(spark):
    d = "/root/testdata/sf0.001"
    signed = materialize(catalogue._signed(spark, d), "signed")
    plan = link.feature_table(settle(lambda: link.candidate_table(signed), "candidates"), signed)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" not in plan and "map_from_arrays" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_long_comb_costs_few_array_operations(monkeypatch):
    calls, plain = [], A.np.maximum
    monkeypatch.setattr(A.np, "maximum", lambda *x, **k: calls.append(1) or plain(*x, **k))
    a, b = ["ab" * 40] * 64, ["ba" * 40] * 64
    assert A._comb(a, b)[0].shape == (80, 64)
    assert len(calls) <= 80 + 80  # a diagonal each, not a cell


def test_features_are_not_dealt_out_again(spark):
    d = "/root/testdata/sf0.001"
    signed = materialize(catalogue._signed(spark, d), "signed")
    pairs = settle(lambda: link.candidate_table(signed), "candidates")
    made = link.feature_table(pairs, signed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ArrowEvalPython")]  # nothing is shuffled once it has its features
    rows = features.fuzzy(features.native(features.attach(pairs, signed)))
    rows = features.rarity(rows, signed, blocking.idf(signed), "addr", "idf")
    rows = features.rarity(rows, signed, blocking.idf(signed, "core"), "core", "nidf")
    rows = link.candidate_context(features.squash_counts(rows, signed))
    columns = ["s1", "s23", "a_addr_empty", *link.NUMERIC]
    got, want = made.select(*columns), materialize(rows.select(*columns), "want")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_what_a_settled_table_left_on_the_way_is_gone(spark):
    inner = []
    out = settle(lambda: inner.append(materialize(spark.range(5), "inner")) or inner[0].where("id > 1"), "outer")
    assert out.agg(F.sum("id")).first()[0] == 9
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner[0]._tessera_path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
