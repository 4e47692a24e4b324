"""Wire format, quality, joins, warehouse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.features import averaged, rounded
from registry.sqlbase import ACCOUNTS, AS_OF, BASE, CATEGORY_LIST, MERCHANTS, RISK, SCORED, TXN, query, rate_of, uniform01
from riskweave import dataset
from riskweave.functions.bands import age_group, credit_band
from riskweave.functions.scalars import clean_amount, uniform01 as draw
from riskweave.operators import quality
from riskweave.operators.keyed import first_write_wins
from riskweave.plans import risk, scoring, staging
from riskweave.schemas import DECISIONS, DRIFT_FEATURES, FRAUD_DEFAULTS
from riskweave.sources.files import table_probe

as_of = dataset.as_of


# --------------------------------------------------------- wire and staging
def topic_payload(spark, path):
    return staging.to_payload(dataset.base_transactions(spark, path))


def parsed_events(spark, path):
    raw = staging.to_payload(dataset.base_transactions(spark, path))
    out = staging.parse_payload(raw.withColumn("value", F.encode("value", "utf-8")))
    return out.select(
        "txn_id", "account_id", "amount", "merchant_category", "is_foreign_merchant", "hour_of_day",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def _events(spark, path):
    txns = dataset.transactions(spark, path)
    return txns.withColumn("event_id", F.col("txn_id"))


def validated_transactions(spark, path):
    tagged = quality.tag_failures(_events(spark, path))
    return tagged.select(
        "txn_id", "amount", F.array_join("failed_rules", ",").alias("failed"), (F.size("failed_rules") == 0).alias("valid")
    )


def staged_transactions(spark, path):
    raw = dataset.replayed_transactions(spark, path).select(
        "txn_id",
        "account_id",
        "merchant_id",
        F.col("amount").cast("string").alias("amount"),
        "merchant_category",
        F.col("hour_of_day").cast("string").alias("hour_of_day"),
        "day_of_week",
        F.lit(0).alias("txn_velocity_1h"),
        F.lit(1.0).alias("amount_vs_avg_ratio"),
        # a replay carries a fresh event id and arrives a second later
        (F.col("created_at") + F.expr("make_dt_interval(0, 0, 0, delivery)")).alias("created_at"),
        F.concat_ws("-", "txn_id", "delivery").alias("event_id"),
    )
    staged, _ = staging.stage(raw)
    return staged.select("txn_id", "account_id", "amount", "hour_of_day", "created_at", "event_id")


def dq_report(spark, path):
    rows, tables = quality.risk_table_rules()
    scored = dataset.scored(spark, path).withColumn("composite_risk_score", F.col("fraud_risk_score"))
    return quality.rule_report(scored, rows, tables)


def disallowed_values(spark, path):
    return quality.disallowed_values(dataset.base_transactions(spark, path), "channel", ["click", "view", "purchase"])


def fk_violations(spark, path):
    txns = dataset.base_transactions(spark, path)
    accounts = quality.orphan_count(txns, dataset.accounts(spark, path), "account_id", "txn_account")
    merchants = quality.orphan_count(txns, dataset.merchants(spark, path), "merchant_id", "txn_merchant")
    return accounts.unionByName(merchants)


def dedup_events(spark, path):
    replayed = dataset.replayed_transactions(spark, path)
    order = [F.col("created_at"), F.col("delivery")]
    return staging.deduplicate(replayed, "txn_id", order).select("txn_id", "account_id", "amount", "created_at", "delivery")


def idempotent_insert(spark, path):
    """Rows a batch of all events inserts into a table that holds purchases."""
    replayed = dataset.replayed_transactions(spark, path)
    target = dataset.base_transactions(spark, path).filter(F.col("channel") == "purchase")
    fresh = first_write_wins(replayed, target, ["txn_id"], [F.col("created_at"), F.col("delivery")])
    return fresh.select("txn_id", "account_id", "amount", "delivery")


def table_probe_query(spark, path):
    txns = table_probe(dataset.base_transactions(spark, path), "transactions", ["txn_id", "account_id", "amount"])
    return txns.unionByName(table_probe(dataset.accounts(spark, path), "accounts", ["account_id", "created_at"]))


# ------------------------------------------------------- joins and features
def account_join(spark, path):
    txns = dataset.transactions(spark, path)
    return txns.select("txn_id", "account_id", "age_days", "avg_monthly_spend", "amount_vs_avg_ratio", age_group(F.col("age_days")).alias("age_group"))


def feature_defaults(spark, path):
    """Defaults applied where purchases lost their optional fields."""
    c = F.col
    lost = c("channel") == "purchase"
    txns = dataset.transactions(spark, path)
    holes = txns.withColumns({n: F.when(~lost, c(n)) for n in FRAUD_DEFAULTS})
    return scoring.fill_defaults(holes, FRAUD_DEFAULTS).select("txn_id", *FRAUD_DEFAULTS)


def cleaned_amounts(spark, path):
    return dataset.base_transactions(spark, path).select("txn_id", clean_amount(F.col("amount") * 100).alias("amount"))


def baseline_current_split(spark, path):
    base, current = staging.baseline_and_current(dataset.base_transactions(spark, path), as_of())
    tag = [df.select("txn_id", F.lit(side).alias("side")) for df, side in ((base, "baseline"), (current, "current"))]
    return tag[0].unionByName(tag[1])


def normal_rows(spark, path):
    return staging.normal_rows(dataset.transactions(spark, path), DRIFT_FEATURES).select("txn_id", *DRIFT_FEATURES)


def standardized_features(spark, path):
    rows = dataset.base_transactions(spark, path).select("txn_id", "amount", "hour_of_day")
    out = staging.standardize(rows, ["amount", "hour_of_day"])
    return rounded(out.select("txn_id", "amount_std", "hour_of_day_std"), "amount_std", "hour_of_day_std")


def stratified_split(spark, path):
    rows = dataset.base_transactions(spark, path)
    uniform = draw(F.concat_ws("|", F.col("is_fraud").cast("string"), "txn_id"), "split")
    return staging.split_by_hash(rows, uniform).select("txn_id", "is_fraud", "split")


def train_and_validation(spark, path):
    return staging.train_and_validation(stratified_split(spark, path))


def stable_sample(spark, path):
    return staging.stable_sample(dataset.base_transactions(spark, path), "txn_id", 5000).select("txn_id", "amount")


def label_rate(spark, path):
    return risk.label_rate(dataset.base_transactions(spark, path))


# --------------------------------------------------------------- warehouse
def rule_scores(spark, path):
    out = scoring.rule_score(dataset.transactions(spark, path))
    return rounded(out.select("txn_id", "rule_risk", "fraud_reason"), "rule_risk")


def linear_scores(spark, path):
    return dataset.scored(spark, path).select("txn_id", "fraud_probability", "fraud_risk_score", "decision", "predicted_fraud")


def decision_audit(spark, path):
    return scoring.model_decisions(dataset.scored(spark, path), F.col("created_at"))


def fraud_alerts(spark, path):
    return scoring.alerts(dataset.scored(spark, path)).select("txn_id", "account_id", "fraud_risk_score", "decision")


def alert_payload(spark, path):
    return staging.alert_payload(scoring.alerts(dataset.scored(spark, path)))


def decision_distribution(spark, path):
    return risk.decision_distribution(dataset.risk_table(spark, path))


def account_summary(spark, path):
    return averaged(rounded(risk.account_summary(dataset.scored(spark, path)), "total_amount"), "avg_amount")


def risk_summary(spark, path):
    return risk.summary(dataset.risk_table(spark, path), as_of())


def weekly_trend(spark, path):
    out = risk.weekly_trend(dataset.risk_table(spark, path), as_of())
    return averaged(out.withColumn("week", F.col("week").cast("timestamp_ntz")), "avg_score")


SHOWN = ["txn_id", "account_id", "composite_risk_score", "decision", "scored_at"]


def risk_search(spark, path):
    return risk.search(dataset.risk_table(spark, path), as_of(), 40, 100, None, 168, 500).select(*SHOWN)


def dashboard_top_risk(spark, path):
    return risk.search(dataset.risk_table(spark, path), as_of(), min_score=75, limit=10).select(*SHOWN)


def top_riskiest(spark, path):
    return risk.by_criteria(dataset.risk_table(spark, path), "top 10 riskiest today", as_of()).select(*SHOWN)


def review_queue(spark, path):
    return risk.by_criteria(dataset.risk_table(spark, path), "Review queue", as_of()).select(*SHOWN)


def newest_fraud(spark, path):
    return risk.by_criteria(dataset.risk_table(spark, path), "fraud decisions", as_of()).select(*SHOWN)


def newest_high_risk(spark, path):
    return risk.by_criteria(dataset.risk_table(spark, path), "high risk", as_of()).select(*SHOWN)


def account_histories(spark, path):
    return risk.every_account_history(dataset.risk_table(spark, path)).select(*SHOWN, "position")


def live_feed(spark, path):
    return risk.live_feed(dataset.risk_table(spark, path)).select(*SHOWN)


def live_feed_stats(spark, path):
    return rounded(risk.live_feed_stats(dataset.risk_table(spark, path), "composite_risk_score"), "avg_metric")


def score_bands(spark, path):
    """Scores under the credit bands, with and without the gaps."""
    score = F.round("fraud_risk_score", 1)
    return dataset.scored(spark, path).select(
        "txn_id", credit_band(score).alias("band"), credit_band(score, gap_free=True).alias("gap_free_band")
    )


QUERIES = {
    "topic_payload": topic_payload,
    "parsed_events": parsed_events,
    "validated_transactions": validated_transactions,
    "staged_transactions": staged_transactions,
    "dq_report": dq_report,
    "disallowed_values": disallowed_values,
    "fk_violations": fk_violations,
    "dedup_events": dedup_events,
    "idempotent_insert": idempotent_insert,
    "table_probe": table_probe_query,
    "account_join": account_join,
    "feature_defaults": feature_defaults,
    "cleaned_amounts": cleaned_amounts,
    "baseline_current_split": baseline_current_split,
    "normal_rows": normal_rows,
    "standardized_features": standardized_features,
    "stratified_split": stratified_split,
    "train_and_validation": train_and_validation,
    "stable_sample": stable_sample,
    "label_rate": label_rate,
    "rule_scores": rule_scores,
    "linear_scores": linear_scores,
    "decision_audit": decision_audit,
    "fraud_alerts": fraud_alerts,
    "alert_payload": alert_payload,
    "decision_distribution": decision_distribution,
    "account_summary": account_summary,
    "risk_summary": risk_summary,
    "weekly_trend": weekly_trend,
    "risk_search": risk_search,
    "dashboard_top_risk": dashboard_top_risk,
    "top_riskiest": top_riskiest,
    "review_queue": review_queue,
    "newest_fraud": newest_fraud,
    "newest_high_risk": newest_high_risk,
    "account_histories": account_histories,
    "live_feed": live_feed,
    "live_feed_stats": live_feed_stats,
    "score_bands": score_bands,
}

_SHOWN = "txn_id, account_id, composite_risk_score, decision, scored_at"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_REPLAYED = BASE + """,
replayed AS (
  SELECT base.*, unnest(CASE WHEN CAST(txn_id AS BIGINT) % 10 = 0 THEN [0, 1] ELSE [0] END) AS delivery FROM base)"""
_BAD = {
    "amount_range": "NOT (amount > 0 AND amount <= 100000)",
    "hour_range": "NOT (hour_of_day BETWEEN 0 AND 23)",
    "day_range": "NOT (day_of_week BETWEEN 0 AND 6)",
    "velocity_range": "NOT (txn_velocity_1h >= 0)",
    "ratio_positive": "NOT (amount_vs_avg_ratio > 0)",
}
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _BAD.items()) + ")"
_SPLIT = f"""
SELECT txn_id, is_fraud, CASE WHEN u < 0.15e0 THEN 'test' WHEN u < 0.15e0 + 0.15e0 * 0.85e0 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, {uniform01("CAST(is_fraud AS VARCHAR) || '|' || txn_id", "split")} AS u FROM base)"""
_DEFAULTED = ["amount", "hour_of_day", "day_of_week", "txn_velocity_1h", "amount_vs_avg_ratio", "is_foreign_merchant", "merchant_category"]


def _default_sql(name):
    value = FRAUD_DEFAULTS[name]
    text = f"'{value}'" if isinstance(value, str) else f"{value}e0" if isinstance(value, float) else str(value)
    return f"coalesce(CASE WHEN channel <> 'purchase' THEN {name} END, {text}) AS {name}"


def _band(score, gap_free):
    if gap_free:
        tests = ["{0} >= 0 AND {0} < 26", "{0} >= 26 AND {0} < 51", "{0} >= 51 AND {0} < 76", "{0} BETWEEN 76 AND 100"]
    else:
        tests = ["{0} BETWEEN 0 AND 25", "{0} BETWEEN 26 AND 50", "{0} BETWEEN 51 AND 75", "{0} BETWEEN 76 AND 100"]
    labels = ["VERY_LOW", "LOW", "MEDIUM", "HIGH"]
    return "CASE " + " ".join(f"WHEN {t.format(score)} THEN '{n}'" for t, n in zip(tests, labels)) + " ELSE 'UNKNOWN' END"


SQL = {
    "stable_sample": query(BASE, "SELECT txn_id, amount FROM base ORDER BY md5(txn_id), txn_id LIMIT 5000"),
    "topic_payload": query(
        BASE,
        f"""SELECT account_id AS key,
        CAST(json_object('txn_id', txn_id, 'account_id', account_id, 'merchant_id', merchant_id, 'amount', amount,
          'merchant_category', merchant_category, 'is_foreign_merchant', is_foreign_merchant, 'hour_of_day', hour_of_day,
          'day_of_week', day_of_week, 'created_at', {_ISO.format("created_at")}, 'event_id', sha256(txn_id)) AS VARCHAR) AS value
        FROM base""",
    ),
    "parsed_events": query(
        BASE,
        "SELECT txn_id, account_id, amount, merchant_category, is_foreign_merchant, hour_of_day, created_at FROM base",
    ),
    "validated_transactions": query(TXN, f"SELECT txn_id, amount, {_FAILED} AS failed, {_FAILED} = '' AS valid FROM txn"),
    "staged_transactions": query(
        _REPLAYED,
        """SELECT txn_id, account_id, amount, hour_of_day, created_at + to_seconds(delivery) AS created_at,
        txn_id || '-' || delivery AS event_id FROM replayed WHERE amount > 0 AND amount <= 100000
        QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY delivery DESC) = 1""",
    ),
    "dq_report": query(
        SCORED,
        """, counts AS (SELECT count(*) AS n, count_if(txn_id IS NULL) AS a,
          count_if(NOT coalesce(fraud_risk_score BETWEEN 0 AND 100, false)) AS b,
          count_if(NOT coalesce(fraud_probability BETWEEN 0 AND 1, false)) AS c,
          count_if(NOT coalesce(decision IN ('FRAUD', 'REVIEW', 'CLEAR'), false)) AS d,
          count_if(is_fraud) / nullif(count(*), 0) AS rate FROM scored)
        SELECT rule, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM (
          SELECT 'txn_id_not_null' AS rule, a AS violations FROM counts
          UNION ALL SELECT 'score_in_0_100', b FROM counts
          UNION ALL SELECT 'probability_in_0_1', c FROM counts
          UNION ALL SELECT 'decision_allowed', d FROM counts
          UNION ALL SELECT 'label_rate_plausible', CASE WHEN rate BETWEEN 0.001 AND 0.5 THEN 0 ELSE 1 END FROM counts
          UNION ALL SELECT 'at_least_100_rows', CASE WHEN n >= 100 THEN 0 ELSE 1 END FROM counts
          UNION ALL SELECT 'not_empty', CASE WHEN n > 0 THEN 0 ELSE 1 END FROM counts)""",
    ),
    "disallowed_values": "SELECT DISTINCT event_type AS channel FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')",
    "fk_violations": query(
        ACCOUNTS + "," + MERCHANTS + "," + BASE,
        """SELECT 'txn_account' AS foreign_key, count(*) AS violations FROM base ANTI JOIN accounts USING (account_id)
        UNION ALL SELECT 'txn_merchant', count(*) FROM base ANTI JOIN merchants USING (merchant_id)""",
    ),
    "dedup_events": query(_REPLAYED, "SELECT txn_id, account_id, amount, created_at, delivery FROM replayed WHERE delivery = 0"),
    "idempotent_insert": query(
        _REPLAYED, "SELECT txn_id, account_id, amount, delivery FROM replayed WHERE delivery = 0 AND channel <> 'purchase'"
    ),
    "table_probe": """SELECT 'transactions' AS table_name, count(*) AS n_rows, 0 AS n_missing_columns, count(*) > 0 AS has_rows FROM events
        UNION ALL SELECT 'accounts', count(*), 1, count(*) > 0 FROM customer""",
    "account_join": query(
        TXN,
        """SELECT txn_id, account_id, age_days, avg_monthly_spend, amount_vs_avg_ratio,
        CASE WHEN age_days <= 365 THEN 'new' WHEN age_days <= 1825 THEN 'established' ELSE 'long_term' END AS age_group FROM txn""",
    ),
    "feature_defaults": query(TXN, "SELECT txn_id, " + ", ".join(_default_sql(n) for n in _DEFAULTED) + " FROM txn"),
    "cleaned_amounts": query(BASE, "SELECT txn_id, round(greatest(least(amount * 100, 50000e0), 0.5e0), 2) AS amount FROM base"),
    "baseline_current_split": query(
        BASE,
        f"""SELECT txn_id, 'baseline' AS side FROM base
          WHERE created_at BETWEEN {AS_OF} - INTERVAL 37 DAY AND {AS_OF} - INTERVAL 7 DAY
        UNION ALL SELECT txn_id, 'current' FROM base WHERE created_at >= {AS_OF} - INTERVAL 7 DAY""",
    ),
    "normal_rows": query(
        TXN, "SELECT txn_id, amount, txn_velocity_1h, amount_vs_avg_ratio, hour_of_day, day_of_week FROM txn WHERE NOT is_fraud"
    ),
    "standardized_features": query(
        BASE,
        """SELECT txn_id, round((amount - (SELECT avg(amount) FROM base)) / (SELECT stddev_pop(amount) FROM base), 6) AS amount_std,
        round((hour_of_day - (SELECT avg(hour_of_day) FROM base)) / (SELECT stddev_pop(hour_of_day) FROM base), 6) AS hour_of_day_std
        FROM base""",
    ),
    "stratified_split": query(BASE, _SPLIT),
    "train_and_validation": query(BASE, f"SELECT * FROM ({_SPLIT}) WHERE split <> 'test'"),
    "label_rate": query(
        BASE,
        """SELECT count(*) AS total, CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS fraud,
        avg(CAST(is_fraud AS INTEGER)) AS fraud_rate FROM base""",
    ),
    "rule_scores": query(
        TXN,
        f"""SELECT txn_id, round(least(rate
          + CASE WHEN is_high_risk THEN 0.15e0 ELSE 0 END + CASE WHEN age_days < 90 THEN 0.05e0 ELSE 0 END
          + CASE WHEN is_foreign_merchant THEN 0.03e0 ELSE 0 END
          + CASE WHEN amount > avg_monthly_spend * 0.5e0 THEN 0.04e0 ELSE 0 END
          + CASE WHEN amount_vs_avg_ratio > 5 THEN 0.08e0 ELSE 0 END
          + CASE WHEN txn_velocity_1h > 5 THEN 0.10e0 ELSE 0 END
          + CASE WHEN hour_of_day IN (0, 1, 2, 3, 4) THEN 0.02e0 ELSE 0 END, 0.95e0), 6) AS rule_risk,
        coalesce(nullif(concat_ws('|',
          CASE WHEN rate > 0.05e0 THEN 'high_risk_merchant_' || merchant_category END,
          CASE WHEN txn_velocity_1h > 5 THEN 'velocity_spike' END,
          CASE WHEN amount_vs_avg_ratio > 5 THEN 'amount_anomaly' END,
          CASE WHEN is_foreign_merchant THEN 'foreign_merchant' END), ''), 'pattern_match') AS fraud_reason
        FROM (SELECT *, {rate_of("merchant_category")} AS rate FROM txn)""",
    ),
    "linear_scores": query(
        SCORED, "SELECT txn_id, fraud_probability, fraud_risk_score, decision, p > 0.5 AS predicted_fraud FROM scored"
    ),
    "decision_audit": query(
        SCORED,
        "SELECT txn_id, 'v1.0' AS model_version, fraud_risk_score AS score, decision, created_at AS decided_at FROM scored",
    ),
    "fraud_alerts": query(
        SCORED, "SELECT txn_id, account_id, fraud_risk_score, decision FROM scored WHERE fraud_risk_score > 75"
    ),
    "alert_payload": query(
        SCORED,
        f"""SELECT txn_id AS key, CAST(json_object('txn_id', txn_id, 'account_id', account_id,
          'fraud_probability', fraud_probability, 'fraud_risk_score', fraud_risk_score, 'decision', decision,
          'scored_at', {_ISO.format("created_at")}) AS VARCHAR) AS value FROM scored WHERE fraud_risk_score > 75""",
    ),
    "decision_distribution": query(RISK, "SELECT decision, count(*) AS n FROM risk GROUP BY decision"),
    "account_summary": query(
        SCORED,
        """SELECT account_id, count(*) AS txn_count, round(sum(amount), 6) AS total_amount, round(avg(amount) + 1e-10, 6) AS avg_amount,
        max(amount) AS max_amount, CAST(count_if(decision = 'FRAUD') AS BIGINT) AS flagged_count, min(created_at) AS first_seen,
        max(created_at) AS last_seen FROM scored GROUP BY account_id""",
    ),
    "risk_summary": query(
        RISK,
        f"""SELECT count(*) AS total_scored_today, round(avg(composite_risk_score), 2) AS avg_risk_score,
        CAST(sum(CASE WHEN decision = 'FRAUD' THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count,
        CAST(sum(CASE WHEN decision = 'REVIEW' THEN 1 ELSE 0 END) AS BIGINT) AS review_count,
        CAST(sum(CASE WHEN decision = 'CLEAR' THEN 1 ELSE 0 END) AS BIGINT) AS clear_count,
        round(CAST(sum(CASE WHEN decision = 'FRAUD' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) * 100, 2) AS fraud_rate_pct
        FROM risk WHERE scored_at > {AS_OF} - INTERVAL 24 HOUR""",
    ),
    "weekly_trend": query(
        RISK,
        f"""SELECT account_id, CAST(date_trunc('week', scored_at) AS TIMESTAMP) AS week,
        round(avg(composite_risk_score) + 1e-10, 6) AS avg_score, max(composite_risk_score) AS max_score, count(*) AS txn_count,
        CAST(sum(CASE WHEN decision = 'FRAUD' THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count
        FROM risk WHERE scored_at > {AS_OF} - INTERVAL 84 DAY GROUP BY ALL""",
    ),
    "risk_search": query(
        RISK,
        f"""SELECT {_SHOWN} FROM risk WHERE composite_risk_score BETWEEN 40 AND 100 AND scored_at > {AS_OF} - INTERVAL 168 HOUR
        ORDER BY composite_risk_score DESC, txn_id LIMIT 500""",
    ),
    "dashboard_top_risk": query(
        RISK,
        f"""SELECT {_SHOWN} FROM risk WHERE composite_risk_score BETWEEN 75 AND 100 AND scored_at > {AS_OF} - INTERVAL 24 HOUR
        ORDER BY composite_risk_score DESC, txn_id LIMIT 10""",
    ),
    "top_riskiest": query(
        RISK,
        f"""SELECT {_SHOWN} FROM risk WHERE scored_at > {AS_OF} - INTERVAL 24 HOUR
        ORDER BY composite_risk_score DESC, txn_id LIMIT 10""",
    ),
    "review_queue": query(
        RISK, f"SELECT {_SHOWN} FROM risk WHERE decision = 'REVIEW' ORDER BY composite_risk_score DESC, txn_id LIMIT 20"
    ),
    "newest_fraud": query(RISK, f"SELECT {_SHOWN} FROM risk WHERE decision = 'FRAUD' ORDER BY scored_at DESC, txn_id LIMIT 20"),
    "newest_high_risk": query(
        RISK, f"SELECT {_SHOWN} FROM risk WHERE composite_risk_score > 75 ORDER BY scored_at DESC, txn_id LIMIT 20"
    ),
    "account_histories": query(
        RISK,
        f"""SELECT {_SHOWN}, CAST(row_number() OVER (PARTITION BY account_id ORDER BY scored_at DESC, txn_id) AS INTEGER) AS position
        FROM risk QUALIFY position <= 20""",
    ),
    "live_feed": query(RISK, f"SELECT {_SHOWN} FROM risk ORDER BY scored_at DESC, txn_id LIMIT 100"),
    "live_feed_stats": query(
        RISK,
        """, feed AS (SELECT * FROM risk ORDER BY scored_at DESC, txn_id LIMIT 100)
        SELECT count(*) AS total, CAST(count_if(decision = 'FRAUD') AS BIGINT) AS flagged, round(avg(composite_risk_score), 6) AS avg_metric,
        list_sort(list(composite_risk_score))[CAST(floor(count(*) * 0.99e0) AS BIGINT) + 1] AS p99_metric FROM feed""",
    ),
    "score_bands": query(
        SCORED,
        f"SELECT txn_id, {_band('s', False)} AS band, {_band('s', True)} AS gap_free_band FROM (SELECT *, round(fraud_risk_score, 1) AS s FROM scored)",
    ),
}
