"""Whole jobs over a fresh warehouse folder, and plain scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.sqlbase import AS_OF, SCORED, query
from riskweave import dataset
from riskweave.plans import jobs
from riskweave.session import run_dir
from riskweave.sinks.warehouse import Warehouse


def pushed_scan(spark, path):
    """Filter and columns reach the Parquet scan."""
    events = dataset.table(spark, path, "events")
    recent = F.col("ts") >= dataset.as_of() - F.expr("INTERVAL 7 DAYS")
    return events.filter(recent & (F.col("value") > 50)).select("event_id", "user_id", "value")


def _loaded(spark, path, times=1):
    warehouse = Warehouse(spark, run_dir(spark, "warehouse"))
    txns = dataset.transactions(spark, path).withColumn("event_id", F.col("txn_id"))
    for _ in range(times):
        jobs.load(
            warehouse,
            txns.drop("account_type", "age_days", "avg_monthly_spend", "region", "is_high_risk"),
            dataset.accounts(spark, path),
            dataset.merchants(spark, path),
        )
    return warehouse


def warehouse_tables(spark, path):
    """Rows per raw table after loading everything twice."""
    warehouse = _loaded(spark, path, times=2)
    counts = [
        warehouse.read(f"raw.{t}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t in ("accounts", "merchants", "transactions")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _scored(spark, path, times=1):
    warehouse = _loaded(spark, path)
    jobs.stage(warehouse)
    for _ in range(times):
        jobs.score(warehouse, warehouse.read("staging.transactions"), F.col("created_at"))
    return warehouse


def job_risk_scores(spark, path):
    """The risk mart after scoring the staged rows twice."""
    scores = _scored(spark, path, times=2).read("mart.risk_scores")
    return scores.select("txn_id", "account_id", "composite_risk_score", "decision", "scored_at")


def job_decision_audit(spark, path):
    """The append-only audit after one scoring run, last day only."""
    since = dataset.as_of() - F.expr("INTERVAL 1 DAY")
    audit = _scored(spark, path).read("audit.model_decisions", since=since)
    return audit.filter(F.col("decided_at") >= since).select("txn_id", "model_version", "score", "decision")


QUERIES = {
    "pushed_scan": pushed_scan,
    "warehouse_tables": warehouse_tables,
    "job_risk_scores": job_risk_scores,
    "job_decision_audit": job_decision_audit,
}

SQL = {
    "pushed_scan": f"SELECT event_id, user_id, value FROM events WHERE ts >= {AS_OF} - INTERVAL 7 DAY AND value > 50",
    "warehouse_tables": """SELECT 'accounts' AS table_name, count(*) AS n FROM customer
        UNION ALL SELECT 'merchants', count(*) FROM part UNION ALL SELECT 'transactions', count(*) FROM events""",
    "job_risk_scores": query(
        SCORED,
        """SELECT txn_id, account_id, fraud_risk_score AS composite_risk_score, decision, created_at AS scored_at
        FROM scored WHERE amount > 0 AND amount <= 100000 AND amount_vs_avg_ratio > 0""",
    ),
    "job_decision_audit": query(
        SCORED,
        f"""SELECT txn_id, 'v1.0' AS model_version, fraud_risk_score AS score, decision FROM scored
        WHERE amount > 0 AND amount <= 100000 AND amount_vs_avg_ratio > 0 AND created_at >= {AS_OF} - INTERVAL 1 DAY""",
    ),
}
