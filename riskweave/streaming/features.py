"""The four window features as streams, upserted into the feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.plans.features import STREAM_FEATURES
from riskweave.plans.staging import parse_payload
from riskweave.schemas import FEATURE_TABLES
from riskweave.sinks.tables import KeyedLog
from riskweave.streaming.runner import await_all, await_any, start

LATENESS = "2 minutes"
INTERVALS = {
    "features_account_txn_counts": "30 seconds",
    "features_velocity": "30 seconds",
    "features_amount_stats": "60 seconds",
    "features_merchant_stats": "60 seconds",
}


def timed(txns: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time as the zoned type that watermarks need."""
    return txns.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)


def from_topic(raw: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return timed(parse_payload(raw), lateness)


def deduplicated(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop repeats of an idempotency key; state is kept for the watermark only."""
    return stream.dropDuplicatesWithinWatermark([key])


def start_features(
    spark: SparkSession,
    stream: DataFrame,
    out: str,
    checkpoints: str,
    tables: list[str] | None = None,
    continuous: bool = False,
) -> list[StreamingQuery]:
    """One query per feature table, each with its own checkpoint and log."""
    queries = []
    for table in tables or list(STREAM_FEATURES):
        log = feature_log(spark, out, table)
        queries.append(
            start(
                STREAM_FEATURES[table](stream),
                table,
                log.write_epoch,
                f"{checkpoints}/{table}",
                INTERVALS[table] if continuous else None,
                once=True,
            )
        )
    return queries


def run_features(spark: SparkSession, stream: DataFrame, out: str, checkpoints: str, tables=None, continuous=False) -> None:
    """Process all available events and stop, or run until interrupted."""
    queries = start_features(spark, stream, out, checkpoints, tables, continuous)
    await_any(spark, queries) if continuous else await_all(queries)


def feature_log(spark: SparkSession, out: str, table: str) -> KeyedLog:
    """A feature table's log, by the day that its windows start on."""
    return KeyedLog(spark, f"{out}/{table}", FEATURE_TABLES[table], day=F.col("window_start"), unique=True)


def feature_table(spark: SparkSession, out: str, table: str, since: Column | None = None, until: Column | None = None) -> DataFrame | None:
    """The newest row of every window, of all days or of those that a time range touches."""
    return feature_log(spark, out, table).current(since, until)
