"""Window features and trailing features."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.sqlbase import BASE, query
from riskweave import dataset
from riskweave.plans import features


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def averaged(df, *columns):
    """Round averages of cents. They often end exactly on a half, where sums
    taken in another order fall to either side; a nudge settles it upwards."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in columns})


def account_hourly(spark, path):
    out = features.account_hourly(dataset.base_transactions(spark, path))
    return averaged(rounded(out, "total_amount_1h"), "avg_amount_1h")


def account_velocity(spark, path):
    return features.account_velocity(dataset.base_transactions(spark, path))


def account_daily(spark, path):
    out = features.account_daily_amounts(dataset.base_transactions(spark, path))
    return averaged(rounded(out, "amount_std_24h"), "amount_mean_24h")


def merchant_half_hourly(spark, path):
    return averaged(features.merchant_half_hourly(dataset.base_transactions(spark, path)), "merchant_avg_amount")


def trailing_velocity(spark, path):
    out = features.trailing_velocity(dataset.base_transactions(spark, path))
    return out.select("txn_id", "account_id", "created_at", "txn_velocity_1h")


def trailing_counts(spark, path):
    out = features.trailing_counts(dataset.base_transactions(spark, path))
    return out.select("txn_id", "txn_count_1m", "txn_count_24h", "txn_count_7d")


def trailing_ratio(spark, path):
    out = features.amount_vs_trailing_average(dataset.base_transactions(spark, path))
    out = out.select("txn_id", "avg_amount_90d", "amount_vs_90d_avg")
    return averaged(out, "amount_vs_90d_avg", "avg_amount_90d")


def trailing_zscore(spark, path):
    out = features.amount_zscore(dataset.base_transactions(spark, path))
    out = out.select("txn_id", "amount_mean_30d", "amount_zscore_30d")
    return averaged(rounded(out, "amount_zscore_30d"), "amount_mean_30d")


def merchant_fraud_rate(spark, path):
    out = features.merchant_fraud_rate(dataset.base_transactions(spark, path))
    return rounded(out.select("txn_id", "merchant_id", "merchant_txns_30d", "merchant_fraud_rate_30d"), "merchant_fraud_rate_30d")


def latest_features(spark, path):
    out = features.latest_features(features.account_hourly(dataset.base_transactions(spark, path)), "account_id")
    return averaged(rounded(out, "total_amount_1h"), "avg_amount_1h")


HOURLY_SQL = """
SELECT account_id, time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
       time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end,
       count(txn_id) AS txn_count_1h, round(sum(amount), 6) AS total_amount_1h,
       round(avg(amount) + 1e-10, 6) AS avg_amount_1h
FROM base GROUP BY ALL"""

VELOCITY_SQL = """
SELECT account_id, window_start, count(txn_id) AS txn_count_5m,
       CASE WHEN count(txn_id) > 5 THEN 1e0 WHEN count(txn_id) > 2 THEN 0.5e0 ELSE 0e0 END AS velocity_score
FROM (SELECT account_id, txn_id,
             unnest([date_trunc('minute', created_at) - to_minutes(i) FOR i IN range(5)]) AS window_start FROM base)
GROUP BY account_id, window_start"""

DAILY_SQL = """
SELECT account_id, time_bucket(INTERVAL 1 DAY, created_at) AS window_start,
       round(avg(amount) + 1e-10, 6) AS amount_mean_24h, round(stddev_samp(amount), 6) AS amount_std_24h,
       count(txn_id) AS txn_count_24h
FROM base GROUP BY account_id, window_start"""

MERCHANT_SQL = """
SELECT merchant_id, time_bucket(INTERVAL 30 MINUTE, created_at) AS window_start,
       count(txn_id) AS merchant_txn_count, round(avg(amount) + 1e-10, 6) AS merchant_avg_amount
FROM base GROUP BY merchant_id, window_start"""


def _frame(micros: int, key: str = "account_id") -> str:
    return f"(PARTITION BY {key} ORDER BY epoch_us(created_at) RANGE BETWEEN {micros} PRECEDING AND CURRENT ROW)"


DAY = 86_400_000_000

QUERIES = {
    "account_hourly_features": account_hourly,
    "account_velocity_5m": account_velocity,
    "account_daily_amount_stats": account_daily,
    "merchant_30m_stats": merchant_half_hourly,
    "trailing_velocity": trailing_velocity,
    "trailing_counts": trailing_counts,
    "trailing_ratio": trailing_ratio,
    "trailing_zscore": trailing_zscore,
    "merchant_fraud_rate_30d": merchant_fraud_rate,
    "latest_features": latest_features,
}

SQL = {
    "account_hourly_features": query(BASE, HOURLY_SQL),
    "account_velocity_5m": query(BASE, VELOCITY_SQL),
    "account_daily_amount_stats": query(BASE, DAILY_SQL),
    "merchant_30m_stats": query(BASE, MERCHANT_SQL),
    "trailing_velocity": query(
        BASE,
        f"SELECT txn_id, account_id, created_at, CAST(count(*) OVER {_frame(3_599_999_999)} - 1 AS INTEGER) AS txn_velocity_1h FROM base",
    ),
    "trailing_counts": query(
        BASE,
        f"""SELECT txn_id, count(*) OVER {_frame(60_000_000)} AS txn_count_1m,
        count(*) OVER {_frame(DAY)} AS txn_count_24h, count(*) OVER {_frame(7 * DAY)} AS txn_count_7d FROM base""",
    ),
    "trailing_ratio": query(
        BASE,
        f"""SELECT txn_id, round(m + 1e-10, 6) AS avg_amount_90d, round(amount / nullif(m, 0) + 1e-10, 6) AS amount_vs_90d_avg
        FROM (SELECT txn_id, amount, avg(amount) OVER {_frame(90 * DAY)} AS m FROM base)""",
    ),
    "trailing_zscore": query(
        BASE,
        f"""SELECT txn_id, round(m + 1e-10, 6) AS amount_mean_30d, round((amount - m) / nullif(s, 0), 6) AS amount_zscore_30d
        FROM (SELECT txn_id, amount, avg(amount) OVER {_frame(30 * DAY)} AS m,
                     stddev_samp(amount) OVER {_frame(30 * DAY)} AS s FROM base)""",
    ),
    "merchant_fraud_rate_30d": query(
        BASE,
        f"""SELECT txn_id, merchant_id, n - 1 AS merchant_txns_30d,
        round(CAST(bad - y AS DOUBLE) / nullif(n - 1, 0), 6) AS merchant_fraud_rate_30d
        FROM (SELECT txn_id, merchant_id, CAST(is_fraud AS INTEGER) AS y,
                     count(*) OVER {_frame(30 * DAY, "merchant_id")} AS n,
                     CAST(sum(CAST(is_fraud AS INTEGER)) OVER {_frame(30 * DAY, "merchant_id")} AS BIGINT) AS bad FROM base)""",
    ),
    "latest_features": query(
        BASE,
        f"SELECT * FROM ({HOURLY_SQL}) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY window_start DESC) = 1",
    ),
}
