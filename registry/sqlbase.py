"""Shared SQL fragments: the adapter of ``riskweave.dataset`` in plain SQL."""

from __future__ import annotations

from riskweave.schemas import CATEGORIES, CATEGORY_BASE_RATES

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


def rate_of(column: str) -> str:
    whens = " ".join(f"WHEN '{c}' THEN {r}e0" for c, r in CATEGORY_BASE_RATES.items())
    return f"(CASE {column} {whens} ELSE 0e0 END)"


ACCOUNTS = """
accounts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS account_id,
         CASE c_mktsegment WHEN 'FURNITURE' THEN 'savings' WHEN 'HOUSEHOLD' THEN 'credit'
                           WHEN 'MACHINERY' THEN 'business' ELSE 'checking' END AS account_type,
         CAST(30 + (c_custkey * 37) % 3620 AS INTEGER) AS age_days,
         100e0 + abs(c_acctbal) AS avg_monthly_spend,
         r_name AS region,
         c_acctbal < 0 AS is_high_risk
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

MERCHANTS = f"""
merchants AS (
  SELECT CAST(p_partkey AS VARCHAR) AS merchant_id, {CATEGORY_LIST}[p_partkey % 13 + 1] AS category,
         p_partkey % 7 = 0 AS is_foreign, p_retailprice AS avg_txn_amount
  FROM part)"""

BASE = f"""
base AS (
  SELECT CAST(event_id AS VARCHAR) AS txn_id, CAST(user_id AS VARCHAR) AS account_id,
         CAST(k AS VARCHAR) AS merchant_id, value AS amount,
         {CATEGORY_LIST}[k % 13 + 1] AS merchant_category, k % 7 = 0 AS is_foreign_merchant,
         CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         event_type = 'error' AS is_fraud, event_type AS channel, ts AS created_at
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

TXN = (
    ACCOUNTS
    + ","
    + BASE
    + """,
txn AS (
  SELECT b.*, account_type, age_days, avg_monthly_spend, region, is_high_risk,
         round(amount / greatest(avg_monthly_spend / 30e0, 1e0), 4) AS amount_vs_avg_ratio
  FROM (SELECT *, CAST(count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(created_at)
                    RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS txn_velocity_1h
        FROM base) b
  JOIN accounts USING (account_id))"""
)


def logit(amount="amount", velocity="txn_velocity_1h", ratio="amount_vs_avg_ratio", foreign=None, category="merchant_category"):
    foreign = foreign or "CAST(CAST(is_foreign_merchant AS INTEGER) AS DOUBLE)"
    return (
        f"-2.2e0 + 0.012e0 * {amount} + 0.6e0 * {velocity} + 0.25e0 * {ratio} + 0.8e0 * {foreign}"
        f" + 10e0 * {rate_of(category)}"
    )


SCORED = (
    TXN
    + f""",
scored AS (
  SELECT *, round(p, 4) AS fraud_probability, round(p * 100, 2) AS fraud_risk_score,
         CASE WHEN p * 100 >= 75 THEN 'FRAUD' WHEN p * 100 >= 40 THEN 'REVIEW' ELSE 'CLEAR' END AS decision
  FROM (SELECT *, 1e0 / (1e0 + exp(-z)) AS p FROM (SELECT *, {logit()} AS z FROM txn)))"""
)

RISK = (
    SCORED
    + """,
risk AS (
  SELECT txn_id, account_id, merchant_id, fraud_probability, CAST(NULL AS DOUBLE) AS credit_risk_score,
         fraud_risk_score AS composite_risk_score, decision, 'v1.0' AS model_version, created_at AS scored_at
  FROM scored)"""
)


def uniform01(key: str, salt: str = "") -> str:
    return f"(CAST(('0x' || substr(md5('{salt}' || {key}), 1, 8)) AS BIGINT) / 4294967296e0)"


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
