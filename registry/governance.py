"""Drift, fairness, overrides and release rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.features import rounded
from registry.sqlbase import SCORED, TXN, query
from riskweave import dataset
from riskweave.functions.bands import age_group
from riskweave.plans import governance
from riskweave.schemas import DRIFT_FEATURES, FAIRNESS_THRESHOLDS

RUNS = ["2024-01-17 00:00:00", "2024-01-24 00:00:00", "2024-01-31 00:00:00"]
LAST_RUN = RUNS[-1:]
TRIGGER_RUNS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00", "2024-01-29 00:00:00"]


def _reports(spark, path, runs):
    return governance.drift_reports(governance.in_windows(dataset.transactions(spark, path), runs))


def drift_report(spark, path):
    return _reports(spark, path, LAST_RUN)


def psi_by_feature(spark, path):
    return _reports(spark, path, RUNS).select("computed_at", "feature", "psi_score", "status")


def histogram_bins(spark, path):
    tagged = governance.in_windows(dataset.transactions(spark, path), LAST_RUN)
    return governance.psi_bins(tagged).select("feature", "side", "bin", "n")


def latest_drift(spark, path):
    out = governance.latest_drift(_reports(spark, path, RUNS))
    return out.select("feature", "computed_at", "psi_score", "status", "drift_detected")


def drift_summary(spark, path):
    return governance.stored_drift_summary(_reports(spark, path, RUNS))


def drift_history(spark, path):
    out = governance.drift_history(_reports(spark, path, RUNS), limit=5)
    return out.select("feature", "computed_at", "psi_score")


def groups():
    return {
        "account_age_group": age_group(F.col("age_days")),
        "region_type": F.col("region"),
        "account_type": F.col("account_type"),
    }


def _weekly(spark, path):
    """Scored rows with the calendar week of their run."""
    week = F.date_trunc("week", "created_at").cast("timestamp_ntz")
    return dataset.scored(spark, path).withColumn("computed_at", week)


def _rates(df, by=None):
    return governance.group_rates(governance.group_counts(df, groups(), "is_fraud", "predicted_fraud", by))


def fairness_by_group(spark, path):
    return rounded(_rates(dataset.scored(spark, path)), "selection_rate", "tpr", "fpr", "precision")


def fairness_metrics(spark, path):
    return governance.fairness_metrics(_rates(dataset.scored(spark, path)))


def fairness_gate(spark, path):
    return governance.gate_checks(fairness_metrics(spark, path))


def fairness_verdict(spark, path):
    return governance.gate_result(fairness_gate(spark, path))


def _weekly_checks(spark, path):
    by = ["computed_at"]
    return governance.gate_checks(governance.fairness_metrics(_rates(_weekly(spark, path), by), by), by=by)


def _weekly_reports(spark, path):
    return governance.fairness_reports(_weekly_checks(spark, path), "fraud_detector", "v1.0")


def fairness_reports(spark, path):
    return _weekly_reports(spark, path)


def latest_fairness(spark, path):
    return governance.latest_fairness(_weekly_reports(spark, path), "fraud_detector")


def released_models(spark, path):
    """Each week's verdict is a model version; weeks with a very large amount
    stand in for the versions that were signed off."""
    version = F.date_format("computed_at", "yyyy-MM-dd").alias("model_version")
    name = F.lit("fraud_detector").alias("model_name")
    reports = _weekly_reports(spark, path).select(name, version, "computed_at", "gate_passed")
    large = dataset.base_transactions(spark, path).filter("amount > 380")
    week = F.date_trunc("week", "created_at").cast("timestamp_ntz").alias("computed_at")
    signs = large.select(week).select(name, version)
    return governance.released(reports, signs).select("computed_at", "gate_passed", "may_release")


def gate_hysteresis(spark, path):
    return governance.gate_hysteresis(_weekly_checks(spark, path))


def retrain_trigger(spark, path):
    drift = _reports(spark, path, TRIGGER_RUNS)
    return governance.retrain_trigger(drift, _weekly_reports(spark, path))


def effective_decisions(spark, path):
    scored = dataset.scored(spark, path)
    return governance.effective_decisions(scored, dataset.human_overrides(scored))


QUERIES = {
    "drift_report": drift_report,
    "psi_by_feature": psi_by_feature,
    "histogram_bins": histogram_bins,
    "latest_drift": latest_drift,
    "drift_summary": drift_summary,
    "drift_history": drift_history,
    "fairness_by_group": fairness_by_group,
    "fairness_metrics": fairness_metrics,
    "fairness_gate": fairness_gate,
    "fairness_verdict": fairness_verdict,
    "fairness_reports": fairness_reports,
    "latest_fairness": latest_fairness,
    "released_models": released_models,
    "gate_hysteresis": gate_hysteresis,
    "retrain_trigger": retrain_trigger,
    "effective_decisions": effective_decisions,
}


def _drift_ctes(runs):
    values = ", ".join(f"(TIMESTAMP '{r}')" for r in runs)
    feature_rows = " UNION ALL ".join(
        f"SELECT computed_at, side, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM tagged" for f in DRIFT_FEATURES
    )
    edges = " + ".join(f"CAST(value >= {i}e0 * ((hi - lo) / 10e0) + lo AS INTEGER)" for i in range(1, 10))
    return (
        TXN
        + f""",
runs(computed_at) AS (VALUES {values}),
tagged AS (
  SELECT t.*, computed_at, 'baseline' AS side FROM txn t JOIN runs
    ON created_at BETWEEN computed_at - INTERVAL 37 DAY AND computed_at - INTERVAL 7 DAY
  UNION ALL
  SELECT t.*, computed_at, 'current' FROM txn t JOIN runs
    ON created_at >= computed_at - INTERVAL 7 DAY AND created_at <= computed_at),
longform AS ({feature_rows}),
bounds AS (
  SELECT computed_at, feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5e0 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5e0 ELSE max(value) END AS hi
  FROM longform WHERE side = 'baseline' GROUP BY ALL),
binned AS (
  SELECT computed_at, feature, side, CASE WHEN value BETWEEN lo AND hi THEN {edges} END AS bin, count(*) AS n, sum(value) AS total
  FROM longform JOIN bounds USING (computed_at, feature) GROUP BY ALL),
sides AS (
  SELECT computed_at, feature, CAST(sum(CASE WHEN side = 'baseline' THEN n END) AS BIGINT) AS bn,
         CAST(sum(CASE WHEN side = 'current' THEN n END) AS BIGINT) AS cn,
         sum(CASE WHEN side = 'baseline' THEN total END) AS bs, sum(CASE WHEN side = 'current' THEN total END) AS cs
  FROM binned GROUP BY ALL),
shares AS (
  SELECT s.*, g.bin,
    coalesce((SELECT sum(n) FROM binned b WHERE b.computed_at = s.computed_at AND b.feature = s.feature AND b.side = 'baseline' AND b.bin = g.bin), 0)
      / CAST(nullif(bn, 0) AS DOUBLE) AS e0,
    coalesce((SELECT sum(n) FROM binned b WHERE b.computed_at = s.computed_at AND b.feature = s.feature AND b.side = 'current' AND b.bin = g.bin), 0)
      / CAST(nullif(cn, 0) AS DOUBLE) AS a0
  FROM sides s, range(10) g(bin)),
psi AS (
  SELECT computed_at, feature, sum((a - e) * ln(a / e)) AS raw, any_value(bn) AS bn, any_value(cn) AS cn, any_value(bs) AS bs, any_value(cs) AS cs
  FROM (SELECT *, CASE WHEN e0 = 0 THEN 1e-6 ELSE e0 END AS e, CASE WHEN a0 = 0 THEN 1e-6 ELSE a0 END AS a FROM shares)
  GROUP BY computed_at, feature),
reports AS (
  SELECT computed_at, feature, round(raw, 4) AS psi_score, status, round(bs / bn, 4) AS baseline_mean,
         round(cs / cn, 4) AS current_mean, status <> 'STABLE' AS drift_detected, bn AS baseline_rows,
         coalesce(cn, 0) AS current_rows, bool_or(status = 'RETRAIN') OVER (PARTITION BY computed_at) AS report_drift,
         CASE WHEN bool_or(status = 'RETRAIN') OVER (PARTITION BY computed_at) THEN 'RETRAIN_REQUIRED' ELSE 'NO_ACTION' END AS recommendation
  FROM (SELECT *, CASE WHEN raw < 0.1 THEN 'STABLE' WHEN raw < 0.2 THEN 'MONITOR' ELSE 'RETRAIN' END AS status FROM psi))"""
    )


_AGE = "CASE WHEN age_days <= 365 THEN 'new' WHEN age_days <= 1825 THEN 'established' ELSE 'long_term' END"
_WEEK = "CAST(date_trunc('week', created_at) AS TIMESTAMP) AS computed_at"


def _fairness_ctes(weekly):
    key = "computed_at, " if weekly else ""
    source = f"SELECT *, {_WEEK} FROM scored" if weekly else "SELECT * FROM scored"
    checks = " UNION ALL ".join(
        f"SELECT {key}attribute, '{m}' AS metric, {m} AS value, {t}e0 AS threshold, {m} > {t}e0 AS breach FROM metrics"
        for m, t in FAIRNESS_THRESHOLDS.items()
    )
    return (
        SCORED
        + f""",
grouped AS (
  SELECT {key}attribute, group_value, is_fraud AS y, p > 0.5 AS yhat FROM (
    SELECT {key}is_fraud, p, 'account_age_group' AS attribute, {_AGE} AS group_value FROM ({source})
    UNION ALL SELECT {key}is_fraud, p, 'region_type', region FROM ({source})
    UNION ALL SELECT {key}is_fraud, p, 'account_type', account_type FROM ({source}))),
counts AS (
  SELECT {key}attribute, group_value, count(*) AS n, CAST(count_if(yhat) AS BIGINT) AS selected,
         CAST(count_if(y) AS BIGINT) AS positives, CAST(count_if(y AND yhat) AS BIGINT) AS true_positives,
         CAST(count_if(NOT y AND yhat) AS BIGINT) AS false_positives
  FROM grouped GROUP BY ALL),
rates AS (
  SELECT *, selected / CAST(n AS DOUBLE) AS selection_rate, coalesce(true_positives / CAST(nullif(positives, 0) AS DOUBLE), 0) AS tpr,
         coalesce(false_positives / CAST(nullif(n - positives, 0) AS DOUBLE), 0) AS fpr,
         CASE WHEN n > 10 AND selected > 0 THEN true_positives / CAST(selected AS DOUBLE) END AS precision
  FROM counts),
metrics AS (
  SELECT {key}attribute, round(max(selection_rate) - min(selection_rate), 4) AS demographic_parity_difference,
         round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 4) AS equal_opportunity_difference,
         round(CASE WHEN count(precision) > 1 THEN max(precision) - min(precision) ELSE 0e0 END, 4) AS predictive_parity_difference,
         round(max(tpr) - min(tpr), 4) AS true_positive_rate_difference, CAST(sum(n) AS BIGINT) AS n_samples
  FROM rates GROUP BY ALL),
checks AS ({checks}),
verdicts AS (
  SELECT {key}NOT bool_or(breach) AS gate_passed, CAST(count_if(breach) AS BIGINT) AS n_failing,
         coalesce(string_agg(attribute || ':' || metric, ',' ORDER BY attribute || ':' || metric) FILTER (breach), '') AS failing
  FROM checks {"GROUP BY computed_at" if weekly else ""})"""
    )


_PLAIN, _WEEKLY = _fairness_ctes(False), _fairness_ctes(True)
_REPORT = "SELECT 'fraud_detector' AS model_name, 'v1.0' AS model_version, gate_passed, n_failing, failing, computed_at FROM verdicts"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY computed_at DESC) = 1"

SQL = {
    "drift_report": query(_drift_ctes(LAST_RUN), "SELECT * FROM reports"),
    "psi_by_feature": query(_drift_ctes(RUNS), "SELECT computed_at, feature, psi_score, status FROM reports"),
    "histogram_bins": query(_drift_ctes(LAST_RUN), "SELECT feature, side, bin, n FROM binned"),
    "latest_drift": query(
        _drift_ctes(RUNS), f"SELECT feature, computed_at, psi_score, status, drift_detected FROM reports {_LATEST}"
    ),
    "drift_summary": query(
        _drift_ctes(RUNS),
        f"""SELECT *, bool_or(drift_detected) OVER () AS overall_drift,
        CASE WHEN bool_or(drift_detected) OVER () THEN 'RETRAIN_REQUIRED' ELSE 'NO_ACTION' END AS overall_recommendation
        FROM (SELECT feature, psi_score, drift_detected, computed_at FROM reports {_LATEST})""",
    ),
    "drift_history": query(
        _drift_ctes(RUNS),
        """SELECT feature, computed_at, psi_score FROM reports
        QUALIFY row_number() OVER (PARTITION BY feature ORDER BY computed_at DESC) <= 5""",
    ),
    "fairness_by_group": query(
        _PLAIN,
        """SELECT attribute, group_value, n, selected, positives, true_positives, false_positives,
        round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM rates""",
    ),
    "fairness_metrics": query(_PLAIN, "SELECT * FROM metrics"),
    "fairness_gate": query(_PLAIN, "SELECT * FROM checks"),
    "fairness_verdict": query(_PLAIN, "SELECT * FROM verdicts"),
    "fairness_reports": query(_WEEKLY, _REPORT),
    "latest_fairness": query(_WEEKLY, _REPORT + " ORDER BY computed_at DESC LIMIT 1"),
    "released_models": query(
        _WEEKLY,
        """SELECT computed_at, gate_passed, gate_passed OR computed_at IN
          (SELECT CAST(date_trunc('week', created_at) AS TIMESTAMP) FROM base WHERE amount > 380) AS may_release FROM verdicts""",
    ),
    "gate_hysteresis": query(
        _WEEKLY,
        """SELECT computed_at, attribute, metric, value, breach,
        bool_and(breach) OVER w AND count(*) OVER w = 3 AS sustained_breach FROM checks
        WINDOW w AS (PARTITION BY attribute, metric ORDER BY computed_at ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    ),
    "effective_decisions": query(
        SCORED,
        """, o AS (
          SELECT txn_id, CASE WHEN is_foreign_merchant THEN 'REVIEW' WHEN channel = 'purchase' THEN 'CLEAR' ELSE 'FRAUD' END AS override_decision
          FROM scored WHERE decision IN ('FRAUD', 'REVIEW') AND channel IN ('purchase', 'signup'))
        SELECT txn_id, decision, coalesce(override_decision, decision) AS effective_decision, override_decision IS NOT NULL AS overridden
        FROM scored LEFT JOIN o USING (txn_id)""",
    ),
}

_DRIFT_TAIL = _drift_ctes(TRIGGER_RUNS)[len(TXN) :]
SQL["retrain_trigger"] = query(
    _WEEKLY + _DRIFT_TAIL,
    """, gate AS (SELECT computed_at, NOT gate_passed AND NOT coalesce(lag(gate_passed) OVER (ORDER BY computed_at), true) AS failed_twice FROM verdicts),
    shifted AS (SELECT computed_at, coalesce(bool_or(psi_score > 0.2), false) AS psi_exceeded FROM reports GROUP BY computed_at)
    SELECT computed_at, coalesce(psi_exceeded, false) AS psi_exceeded, coalesce(failed_twice, false) AS gate_failed_twice,
      coalesce(psi_exceeded, false) OR coalesce(failed_twice, false) AS retrain
    FROM gate FULL JOIN shifted USING (computed_at)""",
)
