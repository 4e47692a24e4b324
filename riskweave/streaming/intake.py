"""Intake: every micro-batch split into valid and rejected rows, both written under its epoch.

Valid rows are keyed by their event id and rejected ones by the digest of what they hold; the first write stays. So an event that comes again, in
the same epoch or a later one, counts once, and a redone epoch gives the same two tables. Features and scores that must not see broken rows start from
``valid_only``, which applies the same rules inside a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.quality import split_valid, transaction_rules
from riskweave.plans.staging import reject_id
from riskweave.sinks.tables import KeyedLog
from riskweave.streaming.runner import start


def known_rules(rows: DataFrame) -> dict[str, Column]:
    """The transaction rules whose column ``rows`` has; a required column that is missing is broken everywhere."""
    needs = {"hour_range": "hour_of_day", "day_range": "day_of_week", "velocity_range": "txn_velocity_1h", "ratio_positive": "amount_vs_avg_ratio"}
    return {name: rule for name, rule in transaction_rules().items() if needs.get(name, rows.columns[0]) in rows.columns}


def valid_only(stream: DataFrame) -> DataFrame:
    """The rows of a stream that break no rule, without state."""
    return split_valid(stream, known_rules(stream))[0]


def valid_log(spark: SparkSession, out: str) -> KeyedLog:
    return KeyedLog(spark, f"{out}/valid", ["event_id"], first=[F.col("created_at")])


def rejected_log(spark: SparkSession, out: str) -> KeyedLog:
    return KeyedLog(spark, f"{out}/rejected", ["reject_id"], first=[F.col("reject_id")])


def start_intake(spark: SparkSession, stream: DataFrame, out: str, checkpoints: str, every: str | None = None) -> StreamingQuery:
    """One query for both tables; the batch is kept while they are written, so it is computed once."""
    valid, rejected = valid_log(spark, out), rejected_log(spark, out)

    def write(batch: DataFrame, epoch: int) -> None:
        good, bad = split_valid(batch, known_rules(batch))
        valid.write_epoch(good, epoch)
        rejected.write_epoch(bad.withColumn("reject_id", reject_id(bad)), epoch)

    return start(stream, "intake", write, f"{checkpoints}/intake", every, output_mode="append")
