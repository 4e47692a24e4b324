"""Continuous scoring: risk scores, decision audit and alerts from one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.quality import split_valid
from riskweave.plans.scoring import alerts, linear_scores, model_decisions, risk_scores
from riskweave.plans.staging import alert_payload, reject_id
from riskweave.schemas import MODEL_VERSION
from riskweave.sinks.tables import KeyedLog
from riskweave.streaming.intake import known_rules, rejected_log
from riskweave.streaming.runner import start


def _log(spark: SparkSession, out: str) -> KeyedLog:
    order = [F.col("scored_at"), F.col("composite_risk_score")]
    return KeyedLog(spark, f"{out}/risk_scores", ["txn_id"], first=order)


def start_scoring(
    spark: SparkSession,
    stream: DataFrame,
    out: str,
    checkpoints: str,
    scorer: Callable[[DataFrame], DataFrame] = linear_scores,
    every: str | None = None,
    version: str = MODEL_VERSION,
    validate: bool = False,
    send: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Score each micro-batch and write the three outputs of its epoch.

    With ``validate`` rows that break a rule are not scored but written to the rejected rows of the same epoch. ``send`` gets the
    (key, value) rows of the alerts besides, for a topic; a redone epoch sends them again, under the same keys.

    The scored batch is kept while its outputs are written, so it is computed
    once. An epoch owns its folders, so a redo replaces rather than repeats. A
    transaction that is delivered again keeps the score it got first.
    """
    scores, rejects = _log(spark, out), rejected_log(spark, out)

    def write(batch: DataFrame, epoch: int) -> None:
        if validate:
            batch, bad = split_valid(batch, known_rules(batch))
            rejects.write_epoch(bad.withColumn("reject_id", reject_id(bad)), epoch)
        scored = scorer(batch).persist()
        try:
            at = F.col("created_at")
            scores.write_epoch(risk_scores(scored, at, version), epoch)
            model_decisions(scored, at, version).write.mode("overwrite").parquet(f"{out}/model_decisions/epoch={epoch}")
            payload = alert_payload(alerts(scored))
            payload.select("value").write.mode("overwrite").text(f"{out}/alerts/epoch={epoch}")
            if send:
                send(payload)
        finally:
            scored.unpersist()

    return start(stream, "scoring", write, f"{checkpoints}/scoring", every, output_mode="append")


def score_table(spark: SparkSession, out: str) -> DataFrame | None:
    return _log(spark, out).current()
