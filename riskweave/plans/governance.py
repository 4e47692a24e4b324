"""Drift (PSI), fairness gate, overrides and release rules.

All reports are computed for a list of runs at once: a run is one ``as_of``
instant for drift and one calendar week for fairness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.bands import psi_status
from riskweave.operators.histogram import histogram, to_long
from riskweave.operators.keyed import latest_per_key, top_per_key
from riskweave.schemas import (
    DRIFT_FEATURES,
    FAIRNESS_THRESHOLDS,
    PSI_BINS,
    PSI_EPSILON,
    PSI_RETRAIN,
)


# ------------------------------------------------------------------- drift
def in_windows(txns: DataFrame, runs: list[str], baseline_days: int = 30, comparison_days: int = 7) -> DataFrame:
    """Tag rows with (computed_at, side) for every run window they fall in.

    The border row of a run belongs to both sides. The run list is part of the
    request, so tagging is an in-row expansion.
    """
    at = F.col("created_at")
    tags = []
    for run in runs:
        now = F.lit(run).cast("timestamp_ntz")
        border = now - F.expr(f"INTERVAL {int(comparison_days)} DAYS")
        start = now - F.expr(f"INTERVAL {int(baseline_days + comparison_days)} DAYS")
        for side, inside in (("baseline", at.between(start, border)), ("current", (at >= border) & (at <= now))):
            tags.append(F.when(inside, F.struct(now.alias("computed_at"), F.lit(side).alias("side"))))
    return txns.withColumn("_tag", F.explode(F.array_compact(F.array(*tags)))).select(
        *txns.columns, "_tag.computed_at", "_tag.side"
    )


def psi_bins(tagged: DataFrame, features: list[str] = DRIFT_FEATURES, bins: int = PSI_BINS) -> DataFrame:
    """Counts per (computed_at, feature, side, bin)."""
    long = to_long(tagged, features, ["computed_at", "side"])
    return histogram(long, "baseline", ["computed_at", "feature"], bins)


def drift_reports(
    tagged: DataFrame,
    features: list[str] = DRIFT_FEATURES,
    bins: int = PSI_BINS,
    retrain_at: float = PSI_RETRAIN,
) -> DataFrame:
    """One row per (computed_at, feature): PSI, status, means, flags.

    Shares divide by all non-null values, those outside the edges included.
    ``report_drift`` is the whole run's flag: any PSI at or above the retrain
    threshold; ``drift_detected`` only says the feature is not stable.
    """
    counts = psi_bins(tagged, features, bins)
    by = ["computed_at", "feature"]

    def on(side: str, column: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col(column)))

    def per_bin(side: str) -> Column:
        entry = F.when((F.col("side") == side) & F.col("bin").isNotNull(), F.struct("bin", "n"))
        return F.map_from_entries(F.collect_list(entry))

    sides = ("baseline", "current")
    # a group has at most ``bins + 1`` rows per side: it folds into one row
    folded = counts.groupBy(*by).agg(
        *[on(s, "n").alias(f"{s}_rows") for s in sides],
        *[on(s, "total").alias(f"{s}_sum") for s in sides],
        *[per_bin(s).alias(f"{s}_bins") for s in sides],
    )

    def share(side: str, index: Column) -> Column:
        filled = F.coalesce(F.try_element_at(F.col(f"{side}_bins"), index), F.lit(0))
        part = F.try_divide(filled, F.col(f"{side}_rows"))
        return F.when(part == 0, F.lit(PSI_EPSILON)).otherwise(part)

    def term(index: Column) -> Column:
        expected, actual = share("baseline", index), share("current", index)
        return (actual - expected) * F.ln(actual / expected)

    indexes = F.sequence(F.lit(0), F.lit(bins - 1))
    psi = folded.withColumn("psi_raw", F.aggregate(indexes, F.lit(0.0), lambda total, i: total + term(i)))
    run = Window.partitionBy("computed_at")
    return (
        psi.withColumn("status", psi_status(F.col("psi_raw")))
        .withColumn("report_drift", F.bool_or(F.coalesce(F.col("psi_raw") >= retrain_at, F.lit(True))).over(run))
        .select(
            *by,
            F.round("psi_raw", 4).alias("psi_score"),
            "status",
            F.round(F.try_divide("baseline_sum", "baseline_rows"), 4).alias("baseline_mean"),
            F.round(F.try_divide("current_sum", "current_rows"), 4).alias("current_mean"),
            (F.col("status") != "STABLE").alias("drift_detected"),
            F.coalesce("baseline_rows", F.lit(0)).alias("baseline_rows"),
            F.coalesce("current_rows", F.lit(0)).alias("current_rows"),
            "report_drift",
            F.when(F.col("report_drift"), "RETRAIN_REQUIRED").otherwise("NO_ACTION").alias("recommendation"),
        )
    )


def latest_drift(reports: DataFrame) -> DataFrame:
    return latest_per_key(reports, ["feature"], ["computed_at"])


def stored_drift_summary(reports: DataFrame) -> DataFrame:
    """Latest row per feature with the stored-report rule.

    Here any unstable feature asks for a retrain, unlike the report's own flag.
    """
    everything = Window.partitionBy(F.lit(1))
    return (
        latest_drift(reports)
        .select("feature", "psi_score", "drift_detected", "computed_at")
        .withColumn("overall_drift", F.bool_or("drift_detected").over(everything))
        .withColumn("overall_recommendation", F.when(F.col("overall_drift"), "RETRAIN_REQUIRED").otherwise("NO_ACTION"))
    )


def drift_history(reports: DataFrame, feature: str | None = None, limit: int = 5) -> DataFrame:
    """Newest reports of one feature, or of every feature."""
    if feature is not None:
        return reports.filter(F.col("feature") == feature).orderBy(F.desc("computed_at")).limit(limit)
    return top_per_key(reports, ["feature"], [F.desc("computed_at")], limit)


# ---------------------------------------------------------------- fairness
def group_counts(
    predicted: DataFrame, groups: dict[str, Column], label: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    """Confusion counts per (by..., attribute, group) from one aggregation.

    ``groups`` maps an attribute name to its group expression. Every attribute
    must exist: a missing one is an error, never a random group.
    """
    by = by or []
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attribute"), g.cast("string").alias("group_value")) for a, g in groups.items()]
    )
    y, p = F.col(label), F.col(prediction)
    return (
        predicted.select(*by, y.alias("_y"), p.alias("_p"), F.inline(pairs))
        .filter(F.col("group_value").isNotNull())
        .groupBy(*by, "attribute", "group_value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_p")).alias("selected"),
            F.count_if(F.col("_y")).alias("positives"),
            F.count_if(F.col("_y") & F.col("_p")).alias("true_positives"),
            F.count_if(~F.col("_y") & F.col("_p")).alias("false_positives"),
        )
    )


def group_rates(counts: DataFrame) -> DataFrame:
    """Rates per group; precision only counts for groups of more than ten rows
    with at least one predicted positive."""
    c = F.col
    zero = F.lit(0.0)
    return counts.withColumns(
        {
            "selection_rate": c("selected") / c("n"),
            "tpr": F.coalesce(F.try_divide("true_positives", "positives"), zero),
            "fpr": F.coalesce(F.try_divide("false_positives", c("n") - c("positives")), zero),
            "precision": F.when((c("n") > 10) & (c("selected") > 0), c("true_positives") / F.nullif(c("selected"), F.lit(0))),
        }
    )


def fairness_metrics(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest gaps between the groups of each attribute.

    ``equal_opportunity_difference`` is the larger of the true- and the
    false-positive gap (equalized odds), which is what the gate tests;
    ``true_positive_rate_difference`` is the plain reading of the name.
    """

    def gap(column: str) -> Column:
        return F.max(column) - F.min(column)

    return (
        rates.groupBy(*(by or []), "attribute")
        .agg(
            gap("selection_rate").alias("_dp"),
            gap("tpr").alias("_tpr"),
            gap("fpr").alias("_fpr"),
            F.when(F.count("precision") > 1, gap("precision")).otherwise(0.0).alias("_pp"),
            F.sum("n").alias("n_samples"),
        )
        .select(
            *(by or []),
            "attribute",
            F.round("_dp", 4).alias("demographic_parity_difference"),
            F.round(F.greatest("_tpr", "_fpr"), 4).alias("equal_opportunity_difference"),
            F.round("_pp", 4).alias("predictive_parity_difference"),
            F.round("_tpr", 4).alias("true_positive_rate_difference"),
            "n_samples",
        )
    )


def gate_checks(metrics: DataFrame, thresholds: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Every (attribute, metric) against its threshold; ``breach`` is strict."""
    thresholds = thresholds or FAIRNESS_THRESHOLDS
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold"))
            for m, t in thresholds.items()
        ]
    )
    return metrics.select(*(by or []), "attribute", F.inline(rows)).withColumn("breach", F.col("value") > F.col("threshold"))


def gate_result(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(gate_passed, failing): one row per run; failing is a sorted text list."""
    fail = F.when(F.col("breach"), F.concat_ws(":", "attribute", "metric"))
    return checks.groupBy(*(by or [])).agg(
        (~F.bool_or("breach")).alias("gate_passed"),
        F.count_if(F.col("breach")).alias("n_failing"),
        # one entry per (attribute, metric) of a run: a dozen at most
        F.array_join(F.array_sort(F.collect_list(fail)), ",").alias("failing"),
    )


def fairness_reports(checks: DataFrame, model_name: str, version: str, by: str = "computed_at") -> DataFrame:
    """Rows of the fairness audit."""
    return gate_result(checks, [by]).select(
        F.lit(model_name).alias("model_name"), F.lit(version).alias("model_version"), "gate_passed", "n_failing", "failing", by
    )


def latest_fairness(reports: DataFrame, model_name: str) -> DataFrame:
    return reports.filter(F.col("model_name") == model_name).orderBy(F.desc("computed_at")).limit(1)


# --------------------------------------------------- overrides and release
def effective_decisions(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Decision in force: the newest human override, else the model's."""
    newest = latest_per_key(overrides, ["txn_id"], ["overridden_at", "override_decision"])
    joined = scores.select("txn_id", "decision").join(newest.select("txn_id", "override_decision"), "txn_id", "left")
    return joined.select(
        "txn_id",
        "decision",
        F.coalesce("override_decision", "decision").alias("effective_decision"),
        F.col("override_decision").isNotNull().alias("overridden"),
    )


def released(reports: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fairness verdict after human sign-off of the same model version."""
    signed = overrides.select("model_name", "model_version").distinct().withColumn("signed_off", F.lit(True))
    return reports.join(signed, ["model_name", "model_version"], "left").withColumn(
        "may_release", F.col("gate_passed") | F.coalesce("signed_off", F.lit(False))
    )


def retrain_trigger(drift: DataFrame, fairness: DataFrame, threshold: float = PSI_RETRAIN) -> DataFrame:
    """Runs that ask for a retrain: a PSI above the threshold in the run, or the
    gate failed in this and the previous run of the model."""
    runs = Window.partitionBy("model_name").orderBy("computed_at")
    gate = fairness.withColumn(
        "gate_failed_twice", ~F.col("gate_passed") & ~F.coalesce(F.lag("gate_passed").over(runs), F.lit(True))
    )
    shifted = drift.groupBy("computed_at").agg(F.bool_or(F.col("psi_score") > threshold).alias("psi_exceeded"))
    joined = gate.select("model_name", "computed_at", "gate_failed_twice").join(shifted, "computed_at", "full")
    return joined.select(
        "computed_at",
        F.coalesce("psi_exceeded", F.lit(False)).alias("psi_exceeded"),
        F.coalesce("gate_failed_twice", F.lit(False)).alias("gate_failed_twice"),
    ).withColumn("retrain", F.col("psi_exceeded") | F.col("gate_failed_twice"))


def gate_hysteresis(checks: DataFrame, runs: int = 3) -> DataFrame:
    """Fail a metric only after ``runs`` breaches in a row."""
    frame = Window.partitionBy("attribute", "metric").orderBy("computed_at").rowsBetween(-(runs - 1), 0)
    return checks.select(
        "computed_at",
        "attribute",
        "metric",
        "value",
        "breach",
        (F.bool_and("breach").over(frame) & (F.count(F.lit(1)).over(frame) == runs)).alias("sustained_breach"),
    )
