"""Behavioural anomaly model: train on normal rows, score everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import clip
from riskweave.operators.forest import Forest, fit_forest, forest_scores
from riskweave.plans.scoring import fill_defaults
from riskweave.plans.staging import normal_rows
from riskweave.schemas import ANOMALY_DEFAULTS, ANOMALY_FEATURES, RISK_BLEND


def _numeric(df: DataFrame) -> DataFrame:
    return df.withColumn("is_foreign_merchant", F.col("is_foreign_merchant").cast("int"))


def train(txns: DataFrame, key: str = "txn_id", **params) -> Forest:
    return fit_forest(_numeric(normal_rows(txns, ANOMALY_FEATURES)), key, ANOMALY_FEATURES, **params)


def score(txns: DataFrame, forest: Forest) -> DataFrame:
    """Raw score, 0-1 score (1 = strangest), flag and share of the blend."""
    raw = forest_scores(_numeric(fill_defaults(txns, ANOMALY_DEFAULTS)), forest)
    normalized = clip(-F.col("anomaly_raw") * 2, 0.0, 1.0)
    return raw.withColumns(
        {
            "is_anomaly": F.col("anomaly_raw") < forest.offset,
            "anomaly_score": F.round(normalized, 4),
            "anomaly_contribution": F.round(normalized * RISK_BLEND["anomaly"] * 100, 2),
        }
    )


def training_summary(scored: DataFrame) -> DataFrame:
    """Flagged share, mean and population deviation of the 0-1 score."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("is_anomaly").cast("int")).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("mean_score"),
        F.stddev_pop("anomaly_score").alias("std_score"),
    )
