"""The four-layer warehouse as folders of Parquet tables.

Large time-keyed tables are partitioned by day, so look-backs read only the
days they need; this takes the place of time-ordered indexes.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.keyed import first_of_stored, first_write_wins
from riskweave.sources.files import parquet_if_exists

LAYERS = ("raw", "staging", "mart", "audit")

# table -> time column whose day partitions it
DAILY = {
    "raw.transactions": "created_at",
    "staging.transactions": "created_at",
    "mart.risk_scores": "scored_at",
    "audit.model_decisions": "decided_at",
    "audit.explanations": "created_at",
}
KEYS = {
    "raw.accounts": ["account_id"],
    "raw.merchants": ["merchant_id"],
    "raw.transactions": ["txn_id"],
    "staging.transactions": ["txn_id"],
    "mart.risk_scores": ["txn_id"],
    "audit.rejected_transactions": ["reject_id"],
    "raw.wide_transactions": ["TransactionID"],
}
DAY = "day"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        layer, _, name = table.partition(".")
        if layer not in LAYERS or not name:
            raise ValueError(f"tables are named <layer>.<name> with a layer of {LAYERS}")
        return f"{self.root}/{layer}/{name}"

    def exists(self, table: str) -> bool:
        return parquet_if_exists(self.spark, self.path(table)) is not None

    def read(self, table: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """A table, limited to the days that a time range touches."""
        found = parquet_if_exists(self.spark, self.path(table))
        if found is None:
            raise LookupError(f"table {table} does not exist; load it first")
        if table not in DAILY:
            return found
        if since is not None:
            found = found.filter(F.col(DAY) >= F.to_date(since))
        if until is not None:
            found = found.filter(F.col(DAY) <= F.to_date(until))
        return found.drop(DAY)

    def first_day(self, table: str) -> datetime.date | None:
        """The first day that a daily table has rows of, from its folders alone."""
        found = parquet_if_exists(self.spark, self.path(table))
        return None if found is None else found.agg(F.min(DAY)).first()[0]

    def append(self, table: str, df: DataFrame) -> None:
        self._write(table, df, "append")

    def replace(self, table: str, df: DataFrame) -> None:
        self._write(table, df, "overwrite")

    def insert_new(self, table: str, df: DataFrame, order: list[Column], stored: bool = False) -> None:
        """Insert rows whose primary key is new; an existing row stays. ``stored``: ``df`` reads a written table, and passes over it are cheap."""
        target = parquet_if_exists(self.spark, self.path(table))
        self.append(table, (first_of_stored if stored else first_write_wins)(df, target, KEYS[table], order))

    def _write(self, table: str, df: DataFrame, mode: str) -> None:
        if table in DAILY:
            dated = df.withColumn(DAY, F.to_date(DAILY[table]))
            # one task per day would be a hot spot; rebalance splits large days
            dated = dated.hint("rebalance", F.col(DAY))
            dated.write.mode(mode).partitionBy(DAY).parquet(self.path(table))
        else:
            df.write.mode(mode).parquet(self.path(table))
