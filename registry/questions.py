"""The risk queries over a stored, day-partitioned mart, and derived features over stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import governance, risk
from registry.features import averaged
from registry.risk import SHOWN
from registry.sqlbase import AS_OF, BASE, query
from riskweave import dataset
from riskweave.plans import questions
from riskweave.session import run_dir
from riskweave.sinks.warehouse import Warehouse


def _mart(spark, path):
    warehouse = Warehouse(spark, run_dir(spark, "mart"))
    warehouse.append(questions.MART, dataset.risk_table(spark, path))
    return warehouse


def _raw(spark, path):
    warehouse = Warehouse(spark, run_dir(spark, "raw"))
    warehouse.append(questions.RAW, dataset.transactions(spark, path))
    return warehouse


def mart_summary(spark, path):
    return questions.summary(_mart(spark, path), dataset.as_of())


def mart_weekly_trend(spark, path):
    out = questions.weekly_trend(_mart(spark, path), dataset.as_of())
    return averaged(out.withColumn("week", F.col("week").cast("timestamp_ntz")), "avg_score")


def mart_search(spark, path):
    found = questions.search(_mart(spark, path), dataset.as_of(), 168, min_score=40, max_score=100, limit=500)
    return found.select(*SHOWN)


def mart_top_riskiest(spark, path):
    return questions.top_riskiest(_mart(spark, path), dataset.as_of()).select(*SHOWN)


def mart_newest_fraud(spark, path):
    return questions.newest_fraud(_mart(spark, path), dataset.as_of()).select(*SHOWN)


def mart_drift_report(spark, path):
    return questions.drift(_raw(spark, path), dataset.AS_OF)


def recent_velocity(spark, path):
    """Trailing velocity of the last week's rows, from the days of that week and one hour more."""
    since = dataset.as_of() - F.expr("INTERVAL 7 DAYS")
    stored = _raw(spark, path)
    return questions.recent_velocity(stored, since).select("txn_id", "account_id", "created_at", "txn_velocity_1h")


QUERIES = {
    "mart_summary": mart_summary,
    "mart_weekly_trend": mart_weekly_trend,
    "mart_search": mart_search,
    "mart_top_riskiest": mart_top_riskiest,
    "mart_newest_fraud": mart_newest_fraud,
    "mart_drift_report": mart_drift_report,
    "recent_velocity": recent_velocity,
}

SQL = {
    "mart_summary": risk.SQL["risk_summary"],
    "mart_weekly_trend": risk.SQL["weekly_trend"],
    "mart_search": risk.SQL["risk_search"],
    "mart_top_riskiest": risk.SQL["top_riskiest"],
    "mart_newest_fraud": risk.SQL["newest_fraud"],
    "mart_drift_report": governance.SQL["drift_report"],
    "recent_velocity": query(
        BASE,
        f"""SELECT * FROM (SELECT txn_id, account_id, created_at, CAST(count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(created_at)
        RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS txn_velocity_1h FROM base) WHERE created_at >= {AS_OF} - INTERVAL 7 DAY""",
    ),
}
