"""Credit-risk index: training target, composite and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.bands import credit_band
from riskweave.functions.scalars import clip, uniform01
from riskweave.schemas import CREDIT_BLEND, RISK_BLEND


def credit_target(residual: Column | None = None) -> Column:
    """Training target in [0, 1] from ratio, velocity, foreign flag and age.

    ``residual`` is the unexplained part, a uniform draw; by default it is
    drawn from the transaction id.
    """
    c = F.col
    noise = uniform01(c("txn_id"), "credit-residual") if residual is None else residual
    risk = (
        F.lit(0.30) * (clip(c("amount_vs_avg_ratio"), 0.0, 20.0) / 20)
        + F.lit(0.25) * (clip(c("txn_velocity_1h").cast("double"), 0.0, 15.0) / 15)
        + F.lit(0.20) * c("is_foreign_merchant").cast("int").cast("double")
        + F.lit(0.15) * (1 - clip(c("account_age_days").cast("double"), 0.0, 3650.0) / 3650)
        + F.lit(0.10) * noise
    )
    return clip(risk, 0.0, 1.0)


def bureau_signal(account_id: Column) -> Column:
    """Stand-in for an external signal: uniform in [0, 0.3), fixed per account."""
    return F.lit(0.3) * uniform01(account_id, "bureau")


def credit_index(df: DataFrame, model: str, anomaly: str, account: str = "account_id", gap_free: bool = False) -> DataFrame:
    """Composite 0-100 score and band from model output and anomaly score."""
    w = CREDIT_BLEND
    part = clip(F.col(model), 0.0, 1.0)
    bureau = bureau_signal(F.col(account))
    blend = w["model"] * part + w["anomaly"] * F.col(anomaly) + w["bureau"] * bureau
    return df.withColumns(
        {
            "model_component": F.round(part, 4),
            "anomaly_component": F.col(anomaly),
            "bureau_component": F.round(bureau, 4),
            "credit_risk_score": F.round(blend * 100, 2),
        }
    ).withColumn("risk_band", credit_band(F.col("credit_risk_score"), gap_free))


def blended_score(fraud: Column, anomaly: Column) -> Column:
    """Fraud probability and anomaly score as one 0-100 score."""
    return (RISK_BLEND["fraud"] * fraud + RISK_BLEND["anomaly"] * anomaly) * 100
