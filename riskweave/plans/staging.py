"""Wire format: topic payloads, parsing, validation and the staging layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import event_key
from riskweave.operators.keyed import top_per_key
from riskweave.operators.quality import split_valid
from riskweave.schemas import TRANSACTION_EVENT

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def to_payload(txns: DataFrame, key: str = "account_id", event_id: Column | None = None) -> DataFrame:
    """(key, value) rows for the transactions topic, keyed for per-account order.

    ``event_id`` defaults to a digest of the transaction id, so a replay sends
    the same idempotency key again.
    """
    fields = [f.name for f in TRANSACTION_EVENT.fields if f.name in txns.columns and f.name not in ("created_at", "event_id")]
    body = F.struct(
        *[F.col(f) for f in fields],
        F.date_format("created_at", ISO_MICROS).alias("created_at"),
        (event_id if event_id is not None else event_key(F.col("txn_id"))).alias("event_id"),
    )
    return txns.select(F.col(key).alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def alert_payload(scored: DataFrame, scored_at: str = "created_at") -> DataFrame:
    """(key, value) rows for the alert topic, keyed by transaction."""
    body = F.struct(
        "txn_id",
        "account_id",
        "fraud_probability",
        "fraud_risk_score",
        "decision",
        F.date_format(scored_at, ISO_MICROS).alias("scored_at"),
    )
    return scored.select(F.col("txn_id").alias("key"), F.to_json(body).alias("value"))


def parse_payload(raw: DataFrame) -> DataFrame:
    """Expand the JSON value; keeps the broker timestamp when there is one.

    A malformed payload or time gives nulls instead of an error, and is caught
    by the required-field rules.
    """
    broker = [F.col("timestamp").alias("broker_timestamp")] if "timestamp" in raw.columns else []
    parsed = raw.select(F.from_json(F.col("value").cast("string"), TRANSACTION_EVENT).alias("txn"), *broker)
    expanded = parsed.select("txn.*", *[c for c in parsed.columns if c != "txn"])
    return expanded.withColumn("created_at", F.try_to_timestamp("created_at"))


def deduplicate(events: DataFrame, key: str = "event_id", order: list[Column] | None = None) -> DataFrame:
    """One row per idempotency key, by default the earliest."""
    return top_per_key(events, [key], order or [F.col("created_at").asc_nulls_last()])


def stage(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean layer: tolerant casts, newest row per transaction, valid rows only.

    Returns (staged, quarantined). Extra columns of the input pass through.
    """
    typed = raw.withColumns(
        {
            f.name: F.col(f.name).try_cast(f.dataType)
            for f in TRANSACTION_EVENT.fields
            if f.name in raw.columns and f.name != "created_at"
        }
    )
    order = [F.desc("created_at")]
    if "event_id" in raw.columns:
        order.append(F.col("event_id"))
    valid, bad = split_valid(typed)
    return top_per_key(valid, ["txn_id"], order), bad


def reject_id(rows: DataFrame) -> Column:
    """Digest of a whole row, the same whenever the row comes again; the rules that it breaks are no part of it."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "failed_rules")), {"ignoreNullFields": "false"}), 256)


def baseline_and_current(
    txns: DataFrame, as_of: Column, baseline_days: int = 30, comparison_days: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Rows of the baseline and of the comparison window.

    The row exactly on the border belongs to both.
    """
    at = F.col("created_at")
    border = as_of - F.expr(f"INTERVAL {int(comparison_days)} DAYS")
    start = as_of - F.expr(f"INTERVAL {int(baseline_days + comparison_days)} DAYS")
    return txns.filter(at.between(start, border)), txns.filter(at >= border)


def normal_rows(txns: DataFrame, features: list[str]) -> DataFrame:
    """Non-fraud rows with every feature present."""
    return txns.filter(~F.col("is_fraud")).na.drop(subset=features)


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Add ``<feature>_std``: centred and scaled by the population deviation."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in features], *[F.stddev_pop(c).alias(f"{c}_s") for c in features]
        ).alias("s")
    ).scalar()
    out = df.withColumn("_stats", stats)
    return out.select(
        *df.columns,
        *[
            ((F.col(c) - F.col(f"_stats.{c}_m")) / F.nullif(F.col(f"_stats.{c}_s"), F.lit(0.0))).alias(f"{c}_std")
            for c in features
        ],
    )


def stable_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A row-limited sample that is the same on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(rows)


def split_by_hash(df: DataFrame, uniform: Column, holdout: float = 0.15) -> DataFrame:
    """Add ``split``: test, then validation out of the rest, then train.

    ``uniform`` is a repeatable draw per row; drawing it from the label and key
    keeps each label's share in expectation, with no shuffle.
    """
    test = holdout
    validation = holdout * (1 - holdout)
    return df.withColumn(
        "split",
        F.when(uniform < test, "test").when(uniform < test + validation, "validation").otherwise("train"),
    )


def train_and_validation(split: DataFrame) -> DataFrame:
    """The rows of the final fit."""
    return split.filter(F.col("split") == "train").unionByName(split.filter(F.col("split") == "validation"))
