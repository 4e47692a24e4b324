"""Schemas, enumerations and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Wire format, category rates, thresholds and weights. Results
# depend on them, so they are stated here once and in their natural order.
# --------------------------------------------------------------------------
TRANSACTIONS_TOPIC = "transactions.raw"
ALERTS_TOPIC = "alerts.fraud"

CATEGORY_BASE_RATES: dict[str, float] = {
    "grocery": 0.005,
    "restaurant": 0.008,
    "gas_station": 0.012,
    "retail": 0.015,
    "online_retail": 0.025,
    "travel": 0.020,
    "entertainment": 0.018,
    "atm_withdrawal": 0.035,
    "peer_transfer": 0.040,
    "wire_transfer": 0.080,
    "gambling": 0.090,
    "cryptocurrency": 0.095,
    "money_service": 0.085,
}
CATEGORIES: list[str] = list(CATEGORY_BASE_RATES)
ACCOUNT_TYPES = ["checking", "savings", "credit", "business"]
DECISIONS = ["FRAUD", "REVIEW", "CLEAR"]

FRAUD_CUTOFF = 75.0
REVIEW_CUTOFF = 40.0
ALERT_CUTOFF = 75.0
CLASS_CUTOFF = 0.5

# inclusive integer ranges; a score between two ranges has no band
CREDIT_BANDS = [
    (0, 25, "VERY_LOW"),
    (26, 50, "LOW"),
    (51, 75, "MEDIUM"),
    (76, 100, "HIGH"),
]
CREDIT_BLEND = {"model": 0.50, "anomaly": 0.35, "bureau": 0.15}
RISK_BLEND = {"fraud": 0.65, "anomaly": 0.35}

PSI_MONITOR = 0.10
PSI_RETRAIN = 0.20
PSI_BINS = 10
PSI_EPSILON = 1e-6
DRIFT_FEATURES = [
    "amount",
    "txn_velocity_1h",
    "amount_vs_avg_ratio",
    "hour_of_day",
    "day_of_week",
]

FAIRNESS_THRESHOLDS = {
    "demographic_parity_difference": 0.05,
    "equal_opportunity_difference": 0.05,
    "predictive_parity_difference": 0.05,
}

FRAUD_FEATURES = [
    "amount",
    "hour_of_day",
    "day_of_week",
    "txn_velocity_1h",
    "amount_vs_avg_ratio",
    "is_foreign_merchant",
    "merchant_category_encoded",
]
ANOMALY_FEATURES = [
    "amount",
    "txn_velocity_1h",
    "amount_vs_avg_ratio",
    "hour_of_day",
    "day_of_week",
    "is_foreign_merchant",
]
CREDIT_FEATURES = [
    "amount",
    "txn_velocity_1h",
    "amount_vs_avg_ratio",
    "is_foreign_merchant",
    "merchant_category_encoded",
    "account_age_days",
    "avg_monthly_spend",
    "hour_of_day",
    "day_of_week",
]
FEATURE_DESCRIPTIONS = {
    "amount": "Transaction amount in USD",
    "hour_of_day": "Hour of day (0-23) when transaction occurred",
    "day_of_week": "Day of week (0=Monday, 6=Sunday)",
    "txn_velocity_1h": "Number of transactions by this account in the past hour",
    "amount_vs_avg_ratio": "Transaction amount divided by account's 90-day average transaction amount",
    "is_foreign_merchant": "1 if merchant is outside the account's home country",
    "merchant_category_encoded": "Merchant category label-encoded (high-risk categories have higher values)",
}

CREDIT_DESCRIPTIONS = {
    "amount": "Transaction amount in USD",
    "txn_velocity_1h": "Transactions in past hour",
    "amount_vs_avg_ratio": "Amount vs 90-day account average",
    "is_foreign_merchant": "Foreign merchant flag",
    "merchant_category_encoded": "Merchant risk category",
    "account_age_days": "Account age in days (older = lower risk)",
    "avg_monthly_spend": "Account average monthly spend",
    "hour_of_day": "Hour of transaction",
    "day_of_week": "Day of week",
}

# hyper-parameters of the boosted models: lowest, highest, how values are drawn
SEARCH_SPACES = {
    "fraud": {
        "n_estimators": (200, 1000, "whole"),
        "max_depth": (3, 8, "whole"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "uniform"),
        "colsample_bytree": (0.6, 1.0, "uniform"),
        "min_child_weight": (1, 10, "whole"),
        "reg_alpha": (1e-8, 1.0, "log"),
        "reg_lambda": (1e-8, 1.0, "log"),
        "scale_pos_weight": (10.0, 60.0, "uniform"),
    },
    "credit": {
        "n_estimators": (100, 600, "whole"),
        "max_depth": (3, 7, "whole"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "uniform"),
        "colsample_bytree": (0.6, 1.0, "uniform"),
        "reg_alpha": (1e-8, 1.0, "log"),
    },
}
SEARCH_SPACES["wide"] = {**SEARCH_SPACES["fraud"], "scale_pos_weight": (5.0, 30.0, "uniform")}
SEARCH_TRIALS = {"fraud": 30, "credit": 20, "wide": 30}
# features of the wide table that have columns of their own; the packed ones come after them
WIDE_FEATURES = [
    "TransactionAmt",
    "log_amount",
    "hour_of_day",
    "day_of_week",
    "email_match",
    "is_credit",
    "addr1",
    "addr2",
    "dist1",
]

FRAUD_DEFAULTS = {
    "amount": 0.0,
    "hour_of_day": 12,
    "day_of_week": 0,
    "txn_velocity_1h": 0,
    "amount_vs_avg_ratio": 1.0,
    "is_foreign_merchant": False,
    "merchant_category": "unknown",
}
ANOMALY_DEFAULTS = {
    "amount": 100.0,
    "txn_velocity_1h": 0,
    "amount_vs_avg_ratio": 1.0,
    "hour_of_day": 12,
    "day_of_week": 0,
    "is_foreign_merchant": False,
}
CREDIT_DEFAULTS = {
    **ANOMALY_DEFAULTS,
    "merchant_category": "retail",
    "account_age_days": 365,
    "avg_monthly_spend": 1000.0,
}

SENTINEL = -999
NULL_CATEGORY = "__NAN__"
MODEL_VERSION = "v1.0"
# --------------------------------------------------------------------------

TRANSACTION_EVENT = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("is_foreign_merchant", T.BooleanType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("txn_velocity_1h", T.IntegerType()),
        T.StructField("amount_vs_avg_ratio", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("event_id", T.StringType()),
    ]
)
REQUIRED_EVENT_FIELDS = ["txn_id", "account_id", "amount", "created_at", "event_id"]

RISK_SCORES = T.StructType(
    [
        T.StructField("txn_id", T.StringType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("credit_risk_score", T.DoubleType()),
        T.StructField("composite_risk_score", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("scored_at", T.TimestampType()),
    ]
)

# mart tables fed by the streams: table -> primary key
FEATURE_TABLES = {
    "features_account_txn_counts": ["account_id", "window_start"],
    "features_velocity": ["account_id", "window_start"],
    "features_amount_stats": ["account_id", "window_start"],
    "features_merchant_stats": ["merchant_id", "window_start"],
}
