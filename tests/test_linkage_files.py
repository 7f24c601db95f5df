"""Search, samples, sinks, model store and file checks on small tables."""

import random

import pytest

from tessera.operators import decide, evaluate, explore, model, select, validate
from tessera.plans import link
from tessera.sources import files


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = [(a, 100 + b, round(rng.random(), 3), b % 4 == 0) for a in range(30) for b in rng.sample(range(60), 5)]
    truth = [(a, b) for a, b, p, _ in rows if p > 0.6 or rng.random() < 0.1]
    return spark.createDataFrame(rows, "s1 long, s23 long, p double, noaddr boolean"), spark.createDataFrame(truth, "s1 long, s23 long"), spark.range(35).withColumnRenamed("id", "s1")


def test_one_pass_sweep_equals_a_threshold_each(scored):
    pairs, truth, entities = scored
    swept = {(r.mode, r.tau): r.macro_f05 for r in decide.sweep(pairs, truth, entities, taus=[0.2, 0.5, 0.75, 0.99]).collect()}
    assert len(swept) == 12
    for (mode, tau), f in swept.items():
        assert f == pytest.approx(evaluate.macro_f05(decide.decide(pairs, tau, mode), truth, entities).first()[0])


def test_search_takes_the_best_and_never_a_worse_second_threshold(scored):
    pairs, truth, entities = scored
    found = decide.search(pairs, truth, entities, ("partition", "threshold"))
    best = max(r.macro_f05 for r in decide.sweep(pairs, truth, entities, ("partition", "threshold")).collect())
    assert found["macro_f05"] >= best - 1e-4 and found["tau_noaddr"] >= found["tau"]
    kept = decide.decide(pairs, found["tau"], found["mode"], found["tau_noaddr"])
    assert evaluate.macro_f05(kept, truth, entities).first()[0] == pytest.approx(found["macro_f05"])


def test_lookups_refuse_what_is_missing(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="2"):
        select.lookup(rows, table, "k")
    with pytest.raises(ValueError, match="differ"):
        select.aligned(rows, table, ["k"])
    assert select.lookup(rows.where("k = 1"), table, "k").count() == 1


def test_sinks_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "country string, x int")
    assert files.write_by_country(df, f"file://{tmp_path}/t") == ["a", "b"]
    more = df.unionByName(spark.createDataFrame([("c", 3), ("a", 9)], "country string, x int"))
    assert files.write_by_country(more, f"file://{tmp_path}/t", resume=True) == ["c"]
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3]
    files.write_metrics(df.limit(1), str(tmp_path / "m"))
    assert files.read_side(spark, str(tmp_path / "m"), "country string, x int").count() == 1
    files.write_report(df, str(tmp_path / "r"), "x")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["country", "x"]
    wide = files.with_columns_from(df, spark.createDataFrame([("a", 7)], "country string, y int"), ["country"])
    assert {r.country: r.y for r in wide.collect()} == {"a": 7, "b": 0}


def test_file_checks(spark, tmp_path):
    good, bad, csv = tmp_path / "good.tsv", tmp_path / "bad.tsv", tmp_path / "csv.tsv"
    good.write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-3,S3-4\nS1-2\t\n")
    bad.write_bytes(b"source1_entity_id\tmatched\nS1-1 S2-3\nS1-2\t\xff\nS1-3\tS2-1\tS2-2\n")
    csv.write_bytes(b"source1_entity_id,matched_entity_ids\n")
    told = lambda p: {r.rule: r.n for r in validate.file_findings(spark, str(p)).collect()}
    assert told(good) == {}
    assert told(bad) == {"not_utf8": 1, "header": 1, "malformed_row": 2}
    assert told(csv) == {"header": 1, "csv_not_tsv": 1}


def test_ranking_quality_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, label int")
    r = explore.ranking_quality(rows, "p", "label").first()
    assert (r.n, r.positives) == (4, 2) and r.auc == pytest.approx(3.5 / 4) and r.average_precision == pytest.approx((1 + 2 / 3) / 2)
    none = explore.ranking_quality(rows.where("label = 0"), "p", "label").first()
    assert none.auc is None and none.average_precision is None


def test_model_is_stored_and_scorers_plug_in(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.4)
        rows.append((i % 80, i, y, ("TRAIN", "TRAIN", "TRAIN", "CAL")[i % 80 % 4], (i % 80) // 4 % 2, 1 + i % 5, y + rng.random() * 0.8, rng.random()))
    df = spark.createDataFrame(rows, "s1 long, s23 long, label int, role string, fold int, pre_rank int, x1 double, x2 double")
    made = model.train(df, ["x1", "x2"], trees=2, depth=2)
    made.save(f"file://{tmp_path}/model")
    again = model.TwoPass.load(f"file://{tmp_path}/model")
    score = lambda m: {r.s23: round(r.p, 9) for r in model.predict(m, df).collect()}
    assert score(made) == score(again) and again.importances()[0][1] >= again.importances()[-1][1]
    out = model.rescored(spark.createDataFrame([("ab",), ("c",)], "text string"), lambda texts: [float(len(t)) for t in texts])
    assert sorted(r.logit_other for r in out.collect()) == [1.0, 2.0]
    assert model.best_variant({"a": 0.5, "b": 0.7, "c": 0.7}) == "b"


def test_neighbours_join_candidates(spark):
    pairs = spark.createDataFrame([(1, 2, 4)], "s1 long, s23 long, kbits int")
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.2)], "s1 long, s23 long, sim double")
    assert sorted(map(tuple, link.with_neighbours(pairs, near).collect())) == [(1, 2, 20, 0.5), (1, 3, 16, 0.2)]
    assert len(link.NUMERIC) == 66 and len(model.P1) == 7
