"""Whole jobs over a warehouse: load, score, monitor, gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.bands import age_group
from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.operators.quality import split_valid
from riskweave.plans import explain, governance, questions, scoring, staging, wide
from riskweave.schemas import MODEL_VERSION
from riskweave.session import materialize
from riskweave.sinks.warehouse import Warehouse


def load(warehouse: Warehouse, transactions: DataFrame, accounts: DataFrame, merchants: DataFrame) -> None:
    """Insert the three raw tables; rows already present stay as they are."""
    warehouse.insert_new("raw.accounts", accounts, [F.col("account_id")])
    warehouse.insert_new("raw.merchants", merchants, [F.col("merchant_id")])
    warehouse.insert_new("raw.transactions", transactions, [F.col("created_at")])


def load_wide(warehouse: Warehouse, transactions: DataFrame, identity: DataFrame | None = None, key: str = "TransactionID") -> DataFrame:
    """Merge, engineer, encode, prune and pack the wide files, insert the rows that are new, and report what the table then holds.

    ``key`` joins the two files. The label codes that the text columns got are kept beside the table, from its first load on: later
    loads are coded alike.
    """
    merged = wide.engineer(wide.merge(transactions, identity, key))
    merged = materialize(merged if key == "TransactionID" else merged.drop(key), "wide")
    text = wide.text_columns(merged)
    if not warehouse.exists("raw.wide_codes"):
        warehouse.append("raw.wide_codes", fit_codes(merged, text))
    clean = wide.fill_sentinel(apply_codes(merged, warehouse.read("raw.wide_codes"), text))
    # columns that say nothing are left out by the first load; what it packed, later loads pack
    if warehouse.exists("raw.wide_transactions"):
        known = warehouse.read("raw.wide_transactions")
        kept = {*known.columns, *wide.packed_keys(known)}
        clean = clean.select(*[c for c in clean.columns if c in kept])
    else:
        clean = wide.drop_near_constant(clean)
    warehouse.insert_new("raw.wide_transactions", wide.pack(clean), [F.col("TransactionDT") if "TransactionDT" in clean.columns else F.col("TransactionID")], stored=True)
    return wide.load_check(warehouse.read("raw.wide_transactions"))


def stage(warehouse: Warehouse) -> DataFrame:
    """Raw to staging; returns the quarantined rows with the rules they break.

    They are stored too, once each however often the job runs.
    """
    staged, quarantined = staging.stage(warehouse.read("raw.transactions"))
    warehouse.replace("staging.transactions", staged)
    _quarantine(warehouse, quarantined)
    return quarantined


def _quarantine(warehouse: Warehouse, rejected: DataFrame) -> None:
    """A rejected row may lack its id, so the digest of what it holds is its key, and the first write stays."""
    rows = rejected.select(
        staging.reject_id(rejected).alias("reject_id"), "txn_id", "failed_rules", F.to_json(F.struct(*rejected.columns)).alias("row")
    )
    warehouse.insert_new("audit.rejected_transactions", rows, [F.col("reject_id")])


def score(
    warehouse: Warehouse,
    transactions: DataFrame,
    scored_at: Column,
    scorer: Callable[[DataFrame], DataFrame] = scoring.linear_scores,
    version: str = MODEL_VERSION,
) -> DataFrame:
    """Validate, score, explain and record a batch; returns the alert payload.

    The scored rows are written once and the four outputs made from them; rows
    that break a rule go to the quarantine table with the rules' names.
    """
    valid, rejected = split_valid(transactions)
    _quarantine(warehouse, rejected)
    scored = materialize(scorer(valid), "scored")
    # a trained model explains its own scores; without that, the fixed linear model does
    top = scoring.top_attributions(scored if "attributions" in scored.columns else scoring.attributions(scored))
    warehouse.append("audit.model_decisions", scoring.model_decisions(scored, scored_at, version))
    warehouse.append("audit.explanations", explain.explanation_rows(top, scored_at))
    warehouse.insert_new("mart.risk_scores", scoring.risk_scores(scored, scored_at, version), [F.col("scored_at")])
    return staging.alert_payload(scoring.alerts(scored))


def monitor_drift(warehouse: Warehouse, as_of: str, retrain_at: float) -> DataFrame:
    """Compute and record the drift report of one day; reads only its windows."""
    report = questions.drift(warehouse, as_of, retrain_at)
    warehouse.append("audit.drift_reports", report)
    return report


def protected_groups() -> dict[str, Column]:
    """Attribute -> group expression; the columns must be there."""
    return {
        "account_age_group": age_group(F.col("age_days")),
        "region_type": F.col("region"),
        "account_type": F.col("account_type"),
    }


def fairness_gate(
    warehouse: Warehouse,
    scored: DataFrame,
    model_name: str,
    version: str,
    computed_at: str,
    thresholds: dict[str, float] | None = None,
    groups: dict[str, Column] | None = None,
) -> DataFrame:
    """Evaluate the gate, record the report and return its one row."""
    counts = governance.group_counts(scored, groups or protected_groups(), "is_fraud", "predicted_fraud")
    checks = governance.gate_checks(governance.fairness_metrics(governance.group_rates(counts)), thresholds)
    dated = checks.withColumn("computed_at", F.lit(computed_at).cast("timestamp_ntz"))
    report = governance.fairness_reports(dated, model_name, version)
    warehouse.append("audit.fairness_reports", report)
    return report


def override_gate(warehouse: Warehouse, model_name: str, version: str, overrider: str, justification: str, at: str) -> None:
    """Record a human sign-off of a failed gate."""
    row = warehouse.spark.createDataFrame(
        [(model_name, version, overrider, justification)],
        "model_name string, model_version string, overrider string, justification string",
    )
    warehouse.append("audit.fairness_overrides", row.withColumn("overridden_at", F.lit(at).cast("timestamp_ntz")))


def override_decisions(warehouse: Warehouse, overrides: DataFrame) -> None:
    """Record analysts' overrides of single decisions."""
    warehouse.append(
        "audit.hitl_overrides",
        overrides.select(
            "txn_id", "original_decision", "override_decision", "analyst_id", "justification", "overridden_at"
        ),
    )
