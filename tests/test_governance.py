"""Drift and fairness rules on small tables, against numpy where it helps."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.plans import governance as g

NOW = datetime(2024, 2, 10)
RUN = "2024-02-10 00:00:00"


def windows(spark, baseline, current):
    rows = [(NOW - timedelta(days=20), float(v)) for v in baseline] + [(NOW - timedelta(days=2), float(v)) for v in current]
    df = spark.createDataFrame(rows, "created_at timestamp, amount double")
    return g.in_windows(df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), [RUN])


def psi(spark, baseline, current):
    return g.drift_reports(windows(spark, baseline, current), ["amount"]).first()


def reference_psi(expected, actual):
    counts, edges = np.histogram(expected, bins=10)
    e, a = counts / len(expected), np.histogram(actual, bins=edges)[0] / len(actual)
    e, a = np.where(e == 0, 1e-6, e), np.where(a == 0, 1e-6, a)
    return float(np.sum((a - e) * np.log(a / e)))


def test_identical_windows_are_stable(spark):
    x = np.random.default_rng(0).normal(0, 1, 1000)
    row = psi(spark, x, x)
    assert row["psi_score"] < 0.01 and row["status"] == "STABLE" and row["recommendation"] == "NO_ACTION"


def test_shift_asks_for_a_retrain(spark):
    rng = np.random.default_rng(1)
    row = psi(spark, rng.normal(0, 1, 1000), rng.normal(5, 1, 1000))
    assert row["psi_score"] > 0.20 and row["recommendation"] == "RETRAIN_REQUIRED"


@pytest.mark.parametrize("seed", range(4))
def test_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    base, cur = rng.lognormal(4, 1, 400), rng.lognormal(4.2, 1.1, 300)
    if seed == 2:  # values on the edges, and outside them
        base, cur = np.arange(0, 101) % 11.0, np.arange(-5, 20) * 1.0
    if seed == 3:  # constant baseline
        base, cur = np.full(50, 7.0), np.array([7.0] * 20 + [7.4, 9.0])
    assert psi(spark, base, cur)["psi_score"] == pytest.approx(round(reference_psi(base, cur), 4), abs=1e-4)


def test_empty_current_window(spark):
    row = psi(spark, [1.0, 2.0], [])
    assert row["psi_score"] is None and row["status"] == "RETRAIN" and row["current_rows"] == 0


def test_border_row_is_in_both_windows(spark):
    df = spark.createDataFrame([(NOW - timedelta(days=7), 1.0)], "created_at timestamp, amount double")
    tagged = g.in_windows(df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), [RUN])
    assert sorted(r["side"] for r in tagged.collect()) == ["baseline", "current"]


def fairness(spark, rows):
    df = spark.createDataFrame(rows, "grp string, y boolean, p boolean")
    return g.group_rates(g.group_counts(df, {"grp": F.col("grp")}, "y", "p"))


def test_small_and_unselected_groups_have_no_precision(spark):
    rows = [("tiny", True, True)] * 10 + [("big", True, True)] * 6 + [("big", False, True)] * 6 + [("none", True, False)] * 20
    rates = {r["group_value"]: r for r in fairness(spark, rows).collect()}
    assert rates["tiny"]["precision"] is None and rates["none"]["precision"] is None
    assert rates["big"]["precision"] == 0.5
    metrics = g.fairness_metrics(fairness(spark, rows)).first()
    assert metrics["predictive_parity_difference"] == 0.0
    assert metrics["demographic_parity_difference"] == 1.0


def test_gate_is_strict(spark):
    rows = [(f"a{i}", m, m, m) for i, m in enumerate([0.05, 0.0501])]
    cols = "attribute string, demographic_parity_difference double, equal_opportunity_difference double, predictive_parity_difference double"
    checks = g.gate_checks(spark.createDataFrame(rows, cols))
    assert {r["attribute"] for r in checks.filter("breach").collect()} == {"a1"}
    verdict = g.gate_result(checks).first()
    assert not verdict["gate_passed"] and verdict["n_failing"] == 3
    assert g.gate_result(checks.filter("attribute = 'a0'")).first()["gate_passed"]


def test_equalized_odds_takes_the_larger_gap(spark):
    rows = [("a", True, True)] * 10 + [("a", False, False)] * 10 + [("b", True, True)] * 10 + [("b", False, True)] * 10
    m = g.fairness_metrics(fairness(spark, rows)).first()
    assert m["true_positive_rate_difference"] == 0.0 and m["equal_opportunity_difference"] == 1.0


def test_hysteresis_needs_three_in_a_row(spark):
    flags = [True, True, False, True, True, True, True]
    rows = [(datetime(2024, 1, 1 + i), "a", "m", 0.1, b) for i, b in enumerate(flags)]
    checks = spark.createDataFrame(rows, "computed_at timestamp, attribute string, metric string, value double, breach boolean")
    got = [r["sustained_breach"] for r in g.gate_hysteresis(checks).orderBy("computed_at").collect()]
    assert got == [False, False, False, False, False, True, True]


def test_retrain_needs_two_failed_gates_or_a_shift(spark):
    days = [datetime(2024, 1, d) for d in range(1, 5)]
    reports = spark.createDataFrame(
        [("m", d, ok) for d, ok in zip(days, [False, True, False, False])], "model_name string, computed_at timestamp, gate_passed boolean"
    )
    drift = spark.createDataFrame([(days[0], "f", 0.2), (days[1], "f", 0.21)], "computed_at timestamp, feature string, psi_score double")
    got = [r["retrain"] for r in g.retrain_trigger(drift, reports).orderBy("computed_at").collect()]
    assert got == [False, True, False, True]


def test_newest_override_counts(spark):
    scores = spark.createDataFrame([("1", "FRAUD"), ("2", "CLEAR")], "txn_id string, decision string")
    overrides = spark.createDataFrame(
        [("1", "CLEAR", datetime(2024, 1, 1)), ("1", "REVIEW", datetime(2024, 1, 2))],
        "txn_id string, override_decision string, overridden_at timestamp",
    )
    got = {r["txn_id"]: r["effective_decision"] for r in g.effective_decisions(scores, overrides).collect()}
    assert got == {"1": "REVIEW", "2": "CLEAR"}


def test_feature_without_baseline_stays_in_the_report(spark):
    from riskweave.plans import governance

    rows = [("r", "baseline", float(i), None) for i in range(20)] + [("r", "current", float(i), 1.0) for i in range(20)]
    tagged = spark.createDataFrame(rows, "computed_at string, side string, amount double, fresh double")
    got = {r["feature"]: r for r in governance.drift_reports(tagged, ["amount", "fresh"]).collect()}
    assert got["amount"]["status"] == "STABLE"
    assert got["fresh"]["status"] == "RETRAIN" and got["fresh"]["psi_score"] is None and got["fresh"]["baseline_rows"] == 0


def test_unknown_override_is_an_error(spark):
    import pytest
    from riskweave.plans import explain

    with pytest.raises(ValueError, match="no_such_feature"):
        explain.what_if(spark.range(1), [{"name": "x", "no_such_feature": 1}])
