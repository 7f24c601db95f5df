"""Training, scoring and calibration of pair classifiers with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import logit
from tessera.operators.context import score_context
from tessera.operators.select import hard_negatives
from tessera.session import materialize, release, settle

VALID, NEG_PER_POS, HARD_RANK = 0.1, 5, 5
P1 = ["p1", "p1_rank", "p1_margin", "p1_sum", "p1_n_above", "p1_rev_rank", "p1_rev_margin"]


def uniform(entity: Column, seed: int = 42) -> Column:
    """In [0, 1), by an arithmetic hash of a whole number, the same in every engine."""
    return F.pmod(entity.cast("bigint") * 2654435761 + seed, F.lit(1_000_003)) / 1_000_003.0


def roles(entities: DataFrame, valid: float = VALID) -> DataFrame:
    """(s1, role, fold): CAL and TUNE get half of ``valid`` each; folds halve the rest. All pairs of an entity go together."""
    u = uniform(F.col("s1"))
    return entities.select("s1", F.when(u < valid / 2, "CAL").when(u < valid, "TUNE").otherwise("TRAIN").alias("role"), (uniform(F.col("s1"), 7919) < 0.5).cast("int").alias("fold"))


def subsample(rows: DataFrame, rank: str = "pre_rank") -> DataFrame:
    """All positives, all hard negatives (well ranked), and easy ones at the rate that gives NEG_PER_POS in all."""
    hard = F.col(rank) <= HARD_RANK
    n = rows.agg(F.sum("label").alias("pos"), F.sum(((F.col("label") == 0) & hard).cast("long")).alias("hard"), F.sum(((F.col("label") == 0) & ~hard).cast("long")).alias("easy")).first()
    rate = min(1.0, max(0.1, (NEG_PER_POS * (n.pos or 0) - (n.hard or 0)) / max(n.easy or 0, 1)))
    return rows.where((F.col("label") == 1) | hard | (uniform(F.col("s1") * 31 + F.col("s23"), 11) < rate))


@dataclass
class TwoPass:
    features: list[str]
    first: list[GBTClassificationModel]
    second: GBTClassificationModel
    isotonic: IsotonicRegressionModel

    def save(self, path: str) -> None:
        """The fitted parts and the feature list, in a folder that may lie in any store."""
        for name, part in [("first0", self.first[0]), ("first1", self.first[1]), ("second", self.second), ("isotonic", self.isotonic)]:
            part.write().overwrite().save(f"{path}/{name}")
        SparkSession.getActiveSession().createDataFrame([(self.features,)], "features array<string>").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> TwoPass:
        features = SparkSession.getActiveSession().read.schema("features array<string>").json(f"{path}/meta").first().features
        first = [GBTClassificationModel.load(f"{path}/first{k}") for k in (0, 1)]
        return cls(list(features), first, GBTClassificationModel.load(f"{path}/second"), IsotonicRegressionModel.load(f"{path}/isotonic"))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, gain share) of the second pass, largest first."""
        return sorted(zip([*self.features, *P1], self.second.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def _fit(rows: DataFrame, features: list[str], trees: int, depth: int) -> GBTClassificationModel:
    return GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, seed=42, stepSize=0.1).fit(VectorAssembler(inputCols=features, outputCol="x").transform(rows))


def _score(model, rows: DataFrame, features: list[str], out: str) -> DataFrame:
    return _scores({out: model}, rows, features)


def _scores(models: dict, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with a column of each model's scores; the features become a vector once."""
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    for out, m in models.items():
        rows = m.transform(rows).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return rows.drop("x")


def _first_pass(models: list, rows: DataFrame, features: list[str]) -> DataFrame:
    features_of = rows
    rows = _scores({f"__p{k}": m for k, m in enumerate(models)}, rows, features)
    mean = (F.col("__p0") + F.col("__p1")) / 2
    own = F.when(F.col("role") != "TRAIN", mean).when(F.col("fold") == 0, F.col("__p0")).otherwise(F.col("__p1")) if "role" in rows.columns else mean
    # only pairs and scores are dealt out to be ranked; the features move once, to meet what came of it
    told = score_context(materialize(rows.select("s1", "s23", own.alias("p1")), "p1"))
    return features_of.join(told, ["s1", "s23"])


def train(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 5) -> TwoPass:
    """``rows``: s1, s23, label, role, fold, pre_rank and features, one row a pair. Pass 1 in two folds, so that pass 2 sees
    out-of-fold scores of its rows; pass 2 adds the competition of those scores; isotonic calibration on CAL."""
    return train_scored(rows, features, trees, depth)[0]


def train_scored(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 5) -> tuple[TwoPass, DataFrame]:
    """As ``train``, and ``rows`` with the first pass's scores, for ``second_pass``."""
    fit = materialize(subsample(rows.where("role = 'TRAIN'")), "fit")
    first = [_fit(fit.where(F.col("fold") != k), features, trees, depth) for k in (0, 1)]
    release(fit)
    scored = settle(lambda: _first_pass(first, rows, features), "first-pass")
    second = _fit(subsample(scored.where("role = 'TRAIN'")), [*features, *P1], trees, depth)
    cal = _score(second, scored.where("role = 'CAL'"), [*features, *P1], "raw")
    return TwoPass(features, first, second, IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="p").fit(cal)), scored


def predict(model: TwoPass, rows: DataFrame) -> DataFrame:
    return second_pass(model, _first_pass(model.first, rows, model.features))


def second_pass(model: TwoPass, scored: DataFrame) -> DataFrame:
    done = _score(model.second, scored, [*model.features, *P1], "raw")
    return model.isotonic.transform(done).withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))


def grey(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return rows.where(F.col("p").between(low, high))


def pseudo_labels(rows: DataFrame, high: float = 0.97, low: float = 0.03) -> DataFrame:
    """Confident pairs as training rows of a country without labels."""
    return rows.where((F.col("p") >= high) | (F.col("p") <= low)).withColumn("label", (F.col("p") >= high).cast("int"))


def stack(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """``rows`` (s1, label, p, logit_other, noaddr) with ``stacked``: logistic regression on both logits, cross-fitted in two
    folds of entities."""
    made = rows.withColumn("logit_p", logit(F.col("p"))).withColumn("noaddr", F.col("noaddr").cast("int")).withColumn("__fold", (uniform(F.col("s1"), 104_729) < 0.5).cast("int"))
    columns, out = ["logit_p", "logit_other", "noaddr"], []
    for k in (0, 1):
        part = VectorAssembler(inputCols=columns, outputCol="x").transform(made.where(F.col("__fold") != k))
        model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / (c * max(part.count(), 1)), elasticNetParam=0.0, standardization=False).fit(part)
        out.append(_score(model, made.where(F.col("__fold") == k), columns, "stacked"))
    return out[0].unionByName(out[1]).drop("__fold", "logit_p")


def fit_entities(entities: DataFrame, most: int) -> DataFrame:
    """At most so many TRAIN entities (s1, role), the first of a seeded draw."""
    return entities.where("role = 'TRAIN'").orderBy(uniform(F.col("s1"), 17), "s1").limit(most)


def rescored(rows: DataFrame, scorer, text: str = "text", out: str = "logit_other") -> DataFrame:
    """``rows`` with the logits of any pair scorer: ``scorer`` gives a list of numbers for a list of texts, and is called
    batch by batch on the workers."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts.tolist()), dtype="float64")

    return rows.withColumn(out, scored(F.col(text)))


def export_pairs(rows: DataFrame, most: int = 3) -> DataFrame:
    """Training pairs of a pair scorer: the grey zone of CAL, and of TRAIN the matches with ``most`` hard negatives a record.
    ``rows``: s1, s23, p, label, role, prescore."""
    train = rows.where("role = 'TRAIN'")
    return grey(rows.where("role = 'CAL'")).unionByName(train.where("label = 1")).unionByName(hard_negatives(train, most))


def best_variant(scores: dict[str, float]) -> str:
    """The name of the highest score; of equal ones the first."""
    return max(scores, key=scores.get)
