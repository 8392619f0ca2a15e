"""Learners around the folds: out-of-fold scores, calibration, filters by score and importance."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """features as a vector; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, depth: int = 3, rounds: int = 10) -> DataFrame:
    """Each row with the score of a boosted model that did not see its fold; positives weigh negatives / positives."""
    data = assembled(df, features)
    pos, neg = data.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    weight = neg / pos if pos and neg else 1.0
    data = data.withColumn("_w", F.when(F.col(label) == 1, weight).otherwise(1.0))
    parts = []
    for k in range(folds):
        model = GBTClassifier(labelCol=label, weightCol="_w", maxDepth=depth, maxIter=rounds, seed=42).fit(data.filter(F.col(fold) != k))
        parts.append(model.transform(data.filter(F.col(fold) == k)).withColumn("prediction", vector_to_array("probability")[1]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("features", "rawPrediction", "probability", "_w")


def importances(df: DataFrame, features: list[str], label: str, depth: int = 3, rounds: int = 10) -> list[tuple[str, float]]:
    """Features with a gain above 0, the largest first."""
    model = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, seed=42).fit(assembled(df, features))
    gains = zip(features, model.featureImportances.toArray().tolist())
    return sorted(((f, g) for f, g in gains if g > 0), key=lambda x: (-x[1], x[0]))


def calibrated(scored: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Isotonic calibration of a score, within 0 and 1."""
    data = scored.withColumn("_x", F.col(score).cast("double"))
    model = IsotonicRegression(featuresCol="_x", labelCol=label, predictionCol="calibrated", **({"weightCol": weight} if weight else {})).fit(data)
    return model.transform(data).withColumn("calibrated", F.greatest(F.least("calibrated", F.lit(1.0)), F.lit(0.0))).drop("_x")


def bad_trade_filter(df: DataFrame, features: list[str], label: str, skip: float = 0.8) -> DataFrame:
    """Balanced logistic score of a bad trade; rows at or above the given percentile of it are skipped."""
    data = assembled(df, features)
    n = data.groupBy().agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    w = F.when(F.col(label) == 1, n.n / (2.0 * max(1, n.p))).otherwise(n.n / (2.0 * max(1, n.n - n.p)))
    data = data.withColumn("_w", w)
    out = LogisticRegression(labelCol=label, weightCol="_w", maxIter=50).fit(data).transform(data)
    out = out.withColumn("bad_score", vector_to_array("probability")[1])
    edge = out.agg(F.percentile("bad_score", F.lit(skip))).first()[0]
    return out.withColumn("skip", F.col("bad_score") >= F.lit(edge)).drop("features", "rawPrediction", "probability", "prediction", "_w")
