"""Warehouse queries over the risk-score mart. Every look-back takes ``as_of``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.keyed import top_per_key
from riskweave.schemas import ALERT_CUTOFF, DECISIONS

_TIE = "txn_id"


def _hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def _count(test: Column) -> Column:
    # sum rather than count_if: null, not 0, on an empty input
    return F.sum(F.when(test, 1).otherwise(0))


def summary(scores: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row of headline numbers for the trailing hours."""
    verdict = F.col("decision")
    fraud = _count(verdict == "FRAUD")
    return scores.filter(F.col("scored_at") > as_of - _hours(hours)).agg(
        F.count(F.lit(1)).alias("total_scored_today"),
        F.round(F.avg("composite_risk_score"), 2).alias("avg_risk_score"),
        fraud.alias("fraud_count"),
        _count(verdict == "REVIEW").alias("review_count"),
        _count(verdict == "CLEAR").alias("clear_count"),
        F.round(F.try_divide(fraud, F.count(F.lit(1))) * 100, 2).alias("fraud_rate_pct"),
    )


def weekly_trend(scores: DataFrame, as_of: Column, weeks: int = 12) -> DataFrame:
    """Weekly score trend, for every account at once."""
    since = as_of - F.expr(f"INTERVAL {int(weeks)} WEEKS")
    return (
        scores.filter(F.col("scored_at") > since)
        .groupBy("account_id", F.date_trunc("week", "scored_at").alias("week"))
        .agg(
            F.avg("composite_risk_score").alias("avg_score"),
            F.max("composite_risk_score").alias("max_score"),
            F.count(F.lit(1)).alias("txn_count"),
            _count(F.col("decision") == "FRAUD").alias("fraud_count"),
        )
    )


def search(
    scores: DataFrame,
    as_of: Column,
    min_score: float = 0,
    max_score: float = 100,
    decision: str | None = None,
    hours_back: int = 24,
    limit: int = 50,
) -> DataFrame:
    """Highest scores matching all filters; at most 500 rows and 168 hours."""
    if not (0 <= min_score <= 100 and 0 <= max_score <= 100):
        raise ValueError("scores lie in 0-100")
    if decision is not None and decision not in DECISIONS:
        raise ValueError(f"decision must be one of {DECISIONS}")
    if not 1 <= hours_back <= 168 or not 1 <= limit <= 500:
        raise ValueError("hours_back in 1-168 and limit in 1-500")
    hits = scores.filter(
        F.col("composite_risk_score").between(min_score, max_score) & (F.col("scored_at") > as_of - _hours(hours_back))
    )
    if decision:
        hits = hits.filter(F.col("decision") == decision)
    return hits.orderBy(F.desc("composite_risk_score"), _TIE).limit(limit)


def newest(scores: DataFrame, test: Column | None = None, limit: int = 20) -> DataFrame:
    hits = scores if test is None else scores.filter(test)
    return hits.orderBy(F.desc("scored_at"), _TIE).limit(limit)


def newest_fraud(scores: DataFrame) -> DataFrame:
    return newest(scores, F.col("decision") == "FRAUD")


def newest_high_risk(scores: DataFrame) -> DataFrame:
    return newest(scores, F.col("composite_risk_score") > ALERT_CUTOFF)


def review_queue(scores: DataFrame, limit: int = 20) -> DataFrame:
    waiting = scores.filter(F.col("decision") == "REVIEW")
    return waiting.orderBy(F.desc("composite_risk_score"), _TIE).limit(limit)


def top_riskiest(scores: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    recent = scores.filter(F.col("scored_at") > as_of - _hours(24))
    return recent.orderBy(F.desc("composite_risk_score"), _TIE).limit(limit)


def account_history(scores: DataFrame, account_id: str, limit: int = 20) -> DataFrame:
    return newest(scores, F.col("account_id") == account_id, limit)


def every_account_history(scores: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows of each account, for all accounts in one job."""
    return top_per_key(scores, ["account_id"], [F.desc("scored_at"), F.col(_TIE)], limit, rank="position")


def by_criteria(scores: DataFrame, criteria: str, as_of: Column) -> DataFrame:
    """Pick a query from free text; the first rule that matches wins."""
    text = criteria.lower()
    account = criteria[text.find("account:") + len("account:") :].strip()
    rules: list[tuple[bool, Callable[[], DataFrame]]] = [
        ("account:" in text, lambda: account_history(scores, account)),
        ("fraud" in text, lambda: newest_fraud(scores)),
        ("review" in text, lambda: review_queue(scores)),
        ("top" in text and "riskiest" in text, lambda: top_riskiest(scores, as_of)),
    ]
    return next((query for hit, query in rules if hit), lambda: newest_high_risk(scores))()


def decision_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def live_feed(scores: DataFrame, limit: int = 100) -> DataFrame:
    return newest(scores, None, limit)


def live_feed_stats(scores: DataFrame, metric: str, limit: int = 100) -> DataFrame:
    """Headline numbers of the newest rows.

    The p99 is the order statistic at index floor(0.99 n) of the sorted list;
    the list holds ``limit`` values at most.
    """
    values = F.array_sort(F.collect_list(metric))
    return (
        live_feed(scores, limit)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("decision") == "FRAUD").alias("flagged"),
            F.avg(metric).alias("avg_metric"),
            values.alias("_sorted"),
        )
        .select(
            "total",
            "flagged",
            "avg_metric",
            F.get("_sorted", F.floor(F.size("_sorted") * 0.99).cast("int")).alias("p99_metric"),
        )
    )


def metric_percentiles(scores: DataFrame, metric: str, points: list[float], accuracy: int = 10000) -> DataFrame:
    """Approximate percentiles over any number of rows."""
    cuts = scores.agg(F.percentile_approx(metric, points, accuracy).alias("v"))
    labels = F.array(*[F.lit(p) for p in points])
    return cuts.select(F.inline(F.arrays_zip(labels.alias("percentile"), F.col("v").alias("value"))))


def account_summary(scored: DataFrame) -> DataFrame:
    """Lifetime summary mart per account."""
    return scored.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.count_if(F.col("decision") == "FRAUD").alias("flagged_count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def label_rate(txns: DataFrame) -> DataFrame:
    return txns.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("is_fraud").cast("int")).alias("fraud"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"),
    )
