"""Boosted trees on ``pyspark.ml``, for fits on all rows of a table; ``models`` has the searched and saved ones."""

from __future__ import annotations

import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.plans.scoring import fill_defaults, with_decision
from riskweave.schemas import CREDIT_DEFAULTS, CREDIT_FEATURES, FRAUD_DEFAULTS, FRAUD_FEATURES

CATEGORY = "merchant_category"


def prepare(df: DataFrame, features: list[str], defaults: dict, codes: DataFrame | None = None) -> DataFrame:
    """Fill, encode the category (unseen -> 0), cast and assemble ``features``."""
    filled = fill_defaults(df, defaults)
    codes = fit_codes(filled, [CATEGORY]) if codes is None else codes
    encoded = apply_codes(filled, codes, [CATEGORY], suffix="_encoded")
    numeric = encoded.withColumn("is_foreign_merchant", F.col("is_foreign_merchant").cast("int"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(numeric)


def prepare_fraud(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    return prepare(df, FRAUD_FEATURES, FRAUD_DEFAULTS, codes).withColumn("label", F.col("is_fraud").cast("double"))


def prepare_credit(df: DataFrame, target: Column, codes: DataFrame | None = None) -> DataFrame:
    return prepare(df, CREDIT_FEATURES, CREDIT_DEFAULTS, codes).withColumn("label", target)


def fit_fraud(train: DataFrame, positive_weight: float = 10.0, **params):
    """Gradient-boosted classifier; rare positives weigh ``positive_weight``."""
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0))
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, **params}
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **settings).fit(weighted)


def score_fraud(prepared: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(prepared).withColumn("raw_probability", vector_to_array("probability")[1])
    return with_decision(scored, "raw_probability").drop("features", "rawPrediction", "probability", "prediction")


def fit_credit(train: DataFrame, **params):
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, **params}
    return GBTRegressor(featuresCol="features", labelCol="label", **settings).fit(train)


def random_grid(estimator, space: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """``trials`` random points of a parameter space."""
    rng = random.Random(seed)
    return [
        {estimator.getParam(name): rng.choice(values) for name, values in space.items()} for _ in range(trials)
    ]


def search(
    train: DataFrame, estimator, space: dict[str, list], trials: int, regression: bool = False, parallelism: int = 2
):
    """Random search scored on a held-out share: AUC, or MAE for regression."""
    evaluator = (
        RegressionEvaluator(labelCol="label", metricName="mae")
        if regression
        else BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    )
    tuner = TrainValidationSplit(
        estimator=estimator,
        estimatorParamMaps=random_grid(estimator, space, trials),
        evaluator=evaluator,
        trainRatio=0.85,
        parallelism=parallelism,
        seed=42,
    )
    return tuner.fit(train)

