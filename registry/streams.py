"""Streaming runs over the event table; the batch SQL is their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import features as feature_queries
from registry.features import averaged, rounded
from registry.sqlbase import BASE, SCORED, query
from riskweave import dataset
from riskweave.functions.scalars import spend_ratio
from riskweave.plans.features import with_accounts
from riskweave.plans.scoring import linear_scores
from riskweave.session import run_dir
from riskweave.sources.topics import replay
from riskweave.streaming import features as streams
from riskweave.streaming import intake, scoring
from riskweave.streaming.runner import await_all


def _stream(spark, path):
    schema = dataset.table(spark, path, "events").schema
    return dataset.events_as_transactions(replay(spark, path, schema, glob="events.parquet"))


def _feature(spark, path, table):
    out = run_dir(spark, "stream")
    streams.run_features(spark, streams.timed(_stream(spark, path)), out, f"{out}/checkpoints", [table])
    result = streams.feature_table(spark, out, table)
    times = [c for c in ("window_start", "window_end") if c in result.columns]
    return result.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def stream_hourly(spark, path):
    return averaged(rounded(_feature(spark, path, "features_account_txn_counts"), "total_amount_1h"), "avg_amount_1h")


def stream_velocity(spark, path):
    return _feature(spark, path, "features_velocity")


def stream_daily(spark, path):
    return averaged(rounded(_feature(spark, path, "features_amount_stats"), "amount_std_24h"), "amount_mean_24h")


def stream_merchant(spark, path):
    return averaged(_feature(spark, path, "features_merchant_stats"), "merchant_avg_amount")


def stream_dedup(spark, path):
    """Every tenth event delivered twice; the repeats must not count."""
    copies = F.when(F.col("txn_id").cast("bigint") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delivered = _stream(spark, path).withColumn("delivery", F.explode(copies))
    out, table = run_dir(spark, "dedup"), "features_account_txn_counts"
    unique = streams.deduplicated(streams.timed(delivered), "txn_id")
    streams.run_features(spark, unique, out, f"{out}/checkpoints", [table])
    result = streams.feature_table(spark, out, table)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return averaged(rounded(result.withColumns(times), "total_amount_1h"), "avg_amount_1h")


def _run_scoring(spark, path):
    """Score the stream with the velocity the events carry: none, hence 0."""
    out = run_dir(spark, "scoring")
    accounts = dataset.accounts(spark, path)

    def scorer(batch):
        joined = with_accounts(batch, accounts)
        return linear_scores(joined.withColumn("amount_vs_avg_ratio", spend_ratio(F.col("amount"), F.col("avg_monthly_spend"))))

    await_all([scoring.start_scoring(spark, _stream(spark, path), out, f"{out}/checkpoints", scorer)])
    return out


def stream_scores(spark, path):
    scores = scoring.score_table(spark, _run_scoring(spark, path))
    return scores.select("txn_id", "account_id", "fraud_probability", "composite_risk_score", "decision")


def stream_alerts(spark, path):
    raw = spark.read.text(f"{_run_scoring(spark, path)}/alerts")
    alert = F.from_json("value", "txn_id string, fraud_risk_score double, decision string")
    return raw.select(alert.alias("a")).select("a.*")


def _broken(spark, path):
    """The event stream with some amounts turned bad, some accounts lost, and every tenth event delivered twice."""
    number = F.col("txn_id").cast("bigint")
    copies = F.when(number % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    stream = _stream(spark, path).withColumns(
        {
            "event_id": F.col("txn_id"),
            "amount": F.when(number % 11 == 0, -F.col("amount")).when(number % 17 == 0, 100000.5).otherwise(F.col("amount")),
            "account_id": F.when(number % 13 != 0, F.col("account_id")),
        }
    )
    return stream.withColumn("delivery", F.explode(copies)).drop("delivery")


def stream_quarantine(spark, path):
    """Both tables of the intake: valid rows, and rejected ones with the rules that they break."""
    out = run_dir(spark, "intake")
    await_all([intake.start_intake(spark, _broken(spark, path), out, f"{out}/checkpoints")])
    valid, rejected = intake.valid_log(spark, out).current(), intake.rejected_log(spark, out).current()
    shown = ["txn_id", "account_id", "amount"]
    return valid.select(*shown, F.lit("").alias("failed")).unionByName(rejected.select(*shown, F.array_join("failed_rules", ",").alias("failed")))


def stream_valid_hourly(spark, path):
    """Hourly features of the valid rows alone."""
    out, table = run_dir(spark, "valid-hourly"), "features_account_txn_counts"
    stream = streams.deduplicated(streams.timed(intake.valid_only(_broken(spark, path))), "txn_id")
    streams.run_features(spark, stream, out, f"{out}/checkpoints", [table])
    result = streams.feature_table(spark, out, table)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return averaged(rounded(result.withColumns(times), "total_amount_1h"), "avg_amount_1h")


QUERIES = {
    "stream_quarantine": stream_quarantine,
    "stream_valid_hourly": stream_valid_hourly,
    "stream_hourly": stream_hourly,
    "stream_velocity": stream_velocity,
    "stream_daily": stream_daily,
    "stream_merchant": stream_merchant,
    "stream_dedup": stream_dedup,
    "stream_scores": stream_scores,
    "stream_alerts": stream_alerts,
}

_STILL = SCORED.replace(
    "CAST(count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(created_at)\n                    RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS INTEGER)",
    "0",
)

_BROKEN = (
    BASE
    + """,
broken AS (
  SELECT txn_id, CASE WHEN CAST(txn_id AS BIGINT) % 13 <> 0 THEN account_id END AS account_id, created_at,
         CASE WHEN CAST(txn_id AS BIGINT) % 11 = 0 THEN -amount WHEN CAST(txn_id AS BIGINT) % 17 = 0 THEN 100000.5e0 ELSE amount END AS amount
  FROM base),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN account_id IS NULL THEN 'account_id_present' END,
                      CASE WHEN NOT (amount > 0 AND amount <= 100000) THEN 'amount_range' END) AS failed
  FROM broken)"""
)

SQL = {
    "stream_quarantine": query(_BROKEN, "SELECT txn_id, account_id, amount, failed FROM judged"),
    "stream_valid_hourly": query(
        _BROKEN.replace("base AS (", "all_events AS (").replace("FROM base)", "FROM all_events)") + ", base AS (SELECT * FROM judged WHERE failed = '')",
        feature_queries.HOURLY_SQL,
    ),
    "stream_hourly": query(BASE, feature_queries.HOURLY_SQL),
    "stream_velocity": query(BASE, feature_queries.VELOCITY_SQL),
    "stream_dedup": query(BASE, feature_queries.HOURLY_SQL),
    "stream_daily": query(BASE, feature_queries.DAILY_SQL),
    "stream_merchant": query(BASE, feature_queries.MERCHANT_SQL),
    "stream_scores": query(
        _STILL, "SELECT txn_id, account_id, fraud_probability, fraud_risk_score AS composite_risk_score, decision FROM scored"
    ),
    "stream_alerts": query(_STILL, "SELECT txn_id, fraud_risk_score, decision FROM scored WHERE fraud_risk_score > 75"),
}
