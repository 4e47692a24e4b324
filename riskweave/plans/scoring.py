"""Scoring of whole tables: rule score, linear model, decisions, attributions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.bands import decision, direction
from riskweave.functions.scalars import base_rate, describe
from riskweave.schemas import ALERT_CUTOFF, CLASS_CUTOFF, FEATURE_DESCRIPTIONS, FRAUD_DEFAULTS, MODEL_VERSION


@dataclass(frozen=True)
class LinearModel:
    """Logistic model over the seven fraud features, in feature order."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)


# fixed weights: the merchant category enters through its base fraud rate
FIXED_MODEL = LinearModel(
    intercept=-2.2,
    weights={
        "amount": 0.012,
        "hour_of_day": 0.0,
        "day_of_week": 0.0,
        "txn_velocity_1h": 0.6,
        "amount_vs_avg_ratio": 0.25,
        "is_foreign_merchant": 0.8,
        "merchant_category_encoded": 10.0,
    },
)


def rule_score(txns: DataFrame, merchant_rate: Column | None = None) -> DataFrame:
    """Additive rule risk with its reason tags.

    Needs the account columns (spend, age, high-risk flag) and the velocity
    and ratio features on each row.
    """
    c = F.col
    rate = base_rate(c("merchant_category")) if merchant_rate is None else merchant_rate

    def points(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    risk = (
        rate
        + points(c("is_high_risk"), 0.15)
        + points(c("age_days") < 90, 0.05)
        + points(c("is_foreign_merchant"), 0.03)
        + points(c("amount") > c("avg_monthly_spend") * 0.5, 0.04)
        + points(c("amount_vs_avg_ratio") > 5.0, 0.08)
        + points(c("txn_velocity_1h") > 5, 0.10)
        + points(c("hour_of_day").between(0, 4), 0.02)
    )
    tags = F.array_compact(
        F.array(
            F.when(rate > 0.05, F.concat(F.lit("high_risk_merchant_"), c("merchant_category"))),
            F.when(c("txn_velocity_1h") > 5, F.lit("velocity_spike")),
            F.when(c("amount_vs_avg_ratio") > 5.0, F.lit("amount_anomaly")),
            F.when(c("is_foreign_merchant"), F.lit("foreign_merchant")),
        )
    )
    return txns.withColumn("rule_risk", F.least(risk, F.lit(0.95))).withColumn(
        "fraud_reason", F.coalesce(F.nullif(F.array_join(tags, "|"), F.lit("")), F.lit("pattern_match"))
    )


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill missing features; a column the input lacks is added whole."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def model_inputs() -> dict[str, Column]:
    """Numeric model input per feature, from default-filled columns."""
    c = F.col
    return {
        "amount": c("amount"),
        "hour_of_day": c("hour_of_day").cast("double"),
        "day_of_week": c("day_of_week").cast("double"),
        "txn_velocity_1h": c("txn_velocity_1h").cast("double"),
        "amount_vs_avg_ratio": c("amount_vs_avg_ratio"),
        "is_foreign_merchant": c("is_foreign_merchant").cast("int").cast("double"),
        "merchant_category_encoded": base_rate(c("merchant_category")),
    }


def logit(model: LinearModel, inputs: dict[str, Column]) -> Column:
    z = F.lit(model.intercept)
    for name, weight in model.weights.items():
        if weight:
            z = z + F.lit(weight) * inputs[name]
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_decision(df: DataFrame, probability: str) -> DataFrame:
    """Rounded probability and score, and the decision on the unrounded score."""
    p = F.col(probability)
    return df.withColumns(
        {
            "fraud_probability": F.round(p, 4),
            "fraud_risk_score": F.round(p * 100, 2),
            "decision": decision(p * 100),
            "predicted_fraud": p > CLASS_CUTOFF,
        }
    )


def linear_scores(txns: DataFrame, model: LinearModel = FIXED_MODEL) -> DataFrame:
    """Fill, score and decide; ``raw_probability`` keeps the unrounded value."""
    filled = fill_defaults(txns, FRAUD_DEFAULTS)
    return with_decision(filled.withColumn("raw_probability", sigmoid(logit(model, model_inputs()))), "raw_probability")


def risk_scores(scored: DataFrame, scored_at: Column, version: str = MODEL_VERSION) -> DataFrame:
    """Rows of the risk-score mart; the composite is the fraud score itself.

    The credit score is null unless the rows were scored for it too.
    """
    credit = F.col("credit_risk_score") if "credit_risk_score" in scored.columns else F.lit(None).cast("double")
    return scored.select(
        "txn_id",
        "account_id",
        "merchant_id",
        "fraud_probability",
        credit.alias("credit_risk_score"),
        F.col("fraud_risk_score").alias("composite_risk_score"),
        "decision",
        F.lit(version).alias("model_version"),
        scored_at.alias("scored_at"),
    )


def model_decisions(scored: DataFrame, decided_at: Column, version: str = MODEL_VERSION) -> DataFrame:
    """Rows of the append-only decision audit."""
    return scored.select(
        "txn_id",
        F.lit(version).alias("model_version"),
        F.col("fraud_risk_score").alias("score"),
        "decision",
        decided_at.alias("decided_at"),
    )


def alerts(scored: DataFrame) -> DataFrame:
    """Rows to alert on: rounded score strictly above the cut-off."""
    return scored.filter(F.col("fraud_risk_score") > ALERT_CUTOFF)


def attributions(scored: DataFrame, model: LinearModel = FIXED_MODEL, background: DataFrame | None = None) -> DataFrame:
    """Add ``attributions``: exact Shapley values of the linear log-odds.

    For a linear model the value of feature j is w_j (x_j - E[x_j]); the means
    come from one aggregate over the background rows (default: the rows
    themselves) that Spark plans as a scalar subquery.
    """
    inputs = model_inputs()
    source = fill_defaults(background if background is not None else scored, FRAUD_DEFAULTS)
    means = source.agg(F.struct(*[F.avg(x).alias(name) for name, x in inputs.items()]).alias("m")).scalar()
    with_means = scored.withColumn("_means", means)
    values = [
        F.struct(
            F.lit(name).alias("feature"),
            (F.lit(model.weights[name]) * (x - F.col("_means")[name])).alias("value"),
        )
        for name, x in inputs.items()
    ]
    return with_means.withColumn("attributions", F.array(*values)).drop("_means")


def top_attributions(attributed: DataFrame, k: int = 5, texts: dict[str, str] = FEATURE_DESCRIPTIONS) -> DataFrame:
    """Replace the array by its ``k`` largest by magnitude, described by ``texts``.

    Sorting happens inside the row: no shuffle. Ties keep feature order.
    """
    ranked = F.transform(
        F.col("attributions"),
        lambda a, i: F.struct((-F.abs(a["value"])).alias("key"), i.alias("pos"), a["feature"].alias("feature"), a["value"].alias("value")),
    )
    best = F.slice(F.array_sort(ranked), 1, k)
    described = F.transform(
        best,
        lambda a: F.struct(
            a["feature"].alias("feature"),
            F.round(a["value"], 4).alias("shap_value"),
            describe(a["feature"], texts).alias("description"),
            direction(a["value"]).alias("direction"),
        ),
    )
    return attributed.withColumn("top_features", described).drop("attributions")


def global_importance(attributed: DataFrame, model: LinearModel = FIXED_MODEL) -> DataFrame:
    """Mean absolute attribution per feature; one pass, one row, then unpivot."""
    names = list(model.weights)
    one = attributed.agg(
        *[F.avg(F.abs(F.element_at("attributions", i + 1)["value"])).alias(n) for i, n in enumerate(names)]
    )
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs_attribution")) for n in names]))
    )
