"""Questions to the stored risk mart: every look-back reaches the scan as a range of days.

The mart and the raw rows are stored by day. A question names the time that it looks back over, and reads only the days which that touches; derived
features read their own span more (a margin), so the first row in question has the same features as if all history had been read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.plans import features, governance, risk
from riskweave.schemas import PSI_RETRAIN
from riskweave.sinks.warehouse import Warehouse

MART = "mart.risk_scores"
RAW = "raw.transactions"


def _span(**units: int) -> Column:
    (unit, n), = units.items()
    return F.expr(f"INTERVAL {int(n)} {unit.upper()}")


def summary(warehouse: Warehouse, as_of: Column, hours: int = 24) -> DataFrame:
    return risk.summary(warehouse.read(MART, since=as_of - _span(hours=hours)), as_of, hours)


def weekly_trend(warehouse: Warehouse, as_of: Column, weeks: int = 12) -> DataFrame:
    return risk.weekly_trend(warehouse.read(MART, since=as_of - _span(weeks=weeks)), as_of, weeks)


def search(warehouse: Warehouse, as_of: Column, hours_back: int = 24, **filters) -> DataFrame:
    return risk.search(warehouse.read(MART, since=as_of - _span(hours=hours_back)), as_of, hours_back=hours_back, **filters)


def top_riskiest(warehouse: Warehouse, as_of: Column, limit: int = 10) -> DataFrame:
    return risk.top_riskiest(warehouse.read(MART, since=as_of - _span(hours=24)), as_of, limit)


def newest(warehouse: Warehouse, as_of: Column, limit: int = 20, days: int = 1, pick: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The newest rows up to ``as_of`` by ``pick`` (default: any), from as few days as hold enough of them.

    The look-back doubles until its days have ``limit`` rows or reach the mart's first day, so a question about the newest rows doesn't sort all history.
    """
    pick = pick or (lambda rows, n: risk.newest(rows, None, n))
    first = warehouse.first_day(MART)
    while True:
        since = as_of - _span(days=days)
        rows = warehouse.read(MART, since=since, until=as_of).filter(F.col("scored_at") <= as_of)
        found = pick(rows.filter(F.col("scored_at") >= F.date_trunc("day", since)), limit)
        reached = first is None or warehouse.spark.range(1).select(F.to_date(since) <= F.lit(first)).first()[0]
        if reached or found.count() >= limit:
            return found
        days *= 2


def newest_fraud(warehouse: Warehouse, as_of: Column, limit: int = 20) -> DataFrame:
    return newest(warehouse, as_of, limit, pick=lambda rows, n: risk.newest(rows, F.col("decision") == "FRAUD", n))


def recent_velocity(warehouse: Warehouse, since: Column) -> DataFrame:
    """Trailing velocity of the rows from ``since`` on; one hour more is read."""
    rows = warehouse.read(RAW, since=since - _span(hours=1))
    return features.trailing_velocity(rows.filter(F.col("created_at") >= since - _span(hours=1))).filter(F.col("created_at") >= since)


def drift(warehouse: Warehouse, as_of: str, retrain_at: float = PSI_RETRAIN) -> DataFrame:
    """Drift report of one day over the days of its two windows."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = warehouse.read(RAW, since=now - _span(days=37), until=now)
    return governance.drift_reports(governance.in_windows(rows, [as_of]), retrain_at=retrain_at)


def ask(warehouse: Warehouse, what: str, as_of: str, **options) -> DataFrame:
    """A question by name, as the command line asks it."""
    now = F.lit(as_of).cast("timestamp_ntz")
    known = {"summary": summary, "trend": weekly_trend, "search": search, "top": top_riskiest, "newest": newest, "newest-fraud": newest_fraud}
    if what not in known:
        raise ValueError(f"questions are {sorted(known)}")
    return known[what](warehouse, now, **options)


QUESTIONS = ("summary", "trend", "search", "top", "newest", "newest-fraud")
