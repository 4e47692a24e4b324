"""Branches the test tables never reach."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskweave.functions import bands, scalars
from riskweave.operators import quality
from riskweave.plans import credit, explain, risk, scoring, staging
from riskweave.schemas import CATEGORIES, CATEGORY_BASE_RATES


def values(spark, column, *inputs, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.orderBy("i").select(column(F.col("v")).alias("o")).collect()]


def test_decision_edges(spark):
    assert values(spark, bands.decision, 90.0, 75.0, 74.999, 40.0, 39.999, 20.0) == [
        "FRAUD", "FRAUD", "REVIEW", "REVIEW", "CLEAR", "CLEAR",
    ]


def test_score_75_is_fraud_but_no_alert(spark):
    df = spark.createDataFrame([("a", 0.75), ("b", 0.7501)], "txn_id string, p double")
    scored = scoring.with_decision(df, "p")
    assert {r["decision"] for r in scored.collect()} == {"FRAUD"}
    assert [r["txn_id"] for r in scoring.alerts(scored).collect()] == ["b"]


def test_credit_band_gaps(spark):
    assert values(spark, bands.credit_band, 0.0, 25.0, 25.5, 26.0, 50.5, 75.5, 100.0) == [
        "VERY_LOW", "VERY_LOW", "UNKNOWN", "LOW", "UNKNOWN", "UNKNOWN", "HIGH",
    ]
    assert values(spark, lambda v: bands.credit_band(v, gap_free=True), 25.5, 50.5, 75.5) == ["VERY_LOW", "LOW", "MEDIUM"]


def test_psi_bands(spark):
    assert values(spark, bands.psi_status, 0.0999, 0.1, 0.1999, 0.2, None) == [
        "STABLE", "MONITOR", "MONITOR", "RETRAIN", "RETRAIN",
    ]


def test_age_groups(spark):
    assert values(spark, bands.age_group, 0, 1, 365, 366, 1825, 1826, 100000, kind="int") == [
        None, "new", "new", "established", "established", "long_term", None,
    ]


def test_scalars(spark):
    assert values(spark, lambda v: scalars.clip(v, 0.0, 1.0), -1.0, 0.5, 2.0, None) == [0.0, 0.5, 1.0, None]
    assert values(spark, scalars.clean_amount, 0.1, 99999.0, 12.345, None) == [0.5, 50000.0, 12.35, None]
    assert values(spark, scalars.tf_flag, "T", "F", "x", None, kind="string") == [1, 0, -1, -1]
    assert values(spark, scalars.elapsed_hour, 0, 3599, 3600, 90000, kind="bigint") == [0, 0, 1, 1]
    assert values(spark, scalars.elapsed_day, 86399, 86400, 7 * 86400, kind="bigint") == [0, 1, 0]
    assert values(spark, scalars.null_if_sentinel, -999.0, 1.0, None) == [None, 1.0, None]
    assert values(spark, scalars.base_rate, "gambling", "unseen", None, kind="string") == [0.09, 0.0, 0.0]
    assert values(spark, lambda v: scalars.describe(v, {"a": "text"}), "a", "b", kind="string") == ["text", "b"]
    draws = values(spark, scalars.uniform01, *[str(i) for i in range(500)], kind="string")
    assert all(0 <= d < 1 for d in draws) and 0.4 < sum(draws) / 500 < 0.6


BASE = {
    "txn_id": "t", "account_id": "a", "merchant_id": "m", "amount": 50.0, "merchant_category": "grocery",
    "is_foreign_merchant": False, "hour_of_day": 12, "day_of_week": 2, "txn_velocity_1h": 0, "amount_vs_avg_ratio": 1.0,
    "is_high_risk": False, "age_days": 1000, "avg_monthly_spend": 3000.0, "event_id": "e",
    "created_at": datetime(2024, 1, 2, 12), "is_fraud": False,
}


def frame(spark, *changes):
    from pyspark.sql import Row
    from pyspark.sql import types as T

    kinds = {str: T.StringType(), float: T.DoubleType(), bool: T.BooleanType(), int: T.IntegerType(), datetime: T.TimestampType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in BASE.items()])
    return spark.createDataFrame([Row(**{**BASE, **c}) for c in changes], schema)


def test_rule_score_terms(spark):
    everything = {
        "merchant_category": "cryptocurrency", "is_foreign_merchant": True, "is_high_risk": True, "age_days": 10,
        "amount": 9500.0, "amount_vs_avg_ratio": 15.0, "txn_velocity_1h": 12, "hour_of_day": 2,
    }
    rows = scoring.rule_score(frame(spark, {}, everything, {"txn_velocity_1h": 6})).collect()
    assert rows[0]["rule_risk"] == 0.005 and rows[0]["fraud_reason"] == "pattern_match"
    assert rows[1]["rule_risk"] == pytest.approx(0.565)
    assert rows[1]["fraud_reason"] == "high_risk_merchant_cryptocurrency|velocity_spike|amount_anomaly|foreign_merchant"
    assert rows[2]["rule_risk"] == pytest.approx(0.105) and rows[2]["fraud_reason"] == "velocity_spike"
    capped = scoring.rule_score(frame(spark, everything), F.lit(0.9)).first()
    assert capped["rule_risk"] == 0.95


def test_high_risk_scores_above_low_risk(spark):
    high = {
        "amount": 9500.0, "merchant_category": "wire_transfer", "is_foreign_merchant": True, "hour_of_day": 2,
        "day_of_week": 6, "txn_velocity_1h": 12, "amount_vs_avg_ratio": 15.0,
    }
    low = {"amount": 42.0, "txn_velocity_1h": 1, "amount_vs_avg_ratio": 0.8, "hour_of_day": 14}
    a, b = scoring.linear_scores(frame(spark, high, low)).collect()
    assert a["decision"] != "CLEAR" and a["fraud_risk_score"] > b["fraud_risk_score"]


def test_validation_names_the_broken_rules(spark):
    bad = [
        {"amount": 0.0}, {"amount": 100000.01}, {"amount": None}, {"hour_of_day": 24}, {"day_of_week": -1},
        {"txn_velocity_1h": -1}, {"amount_vs_avg_ratio": 0.0}, {"created_at": None}, {"event_id": None}, {"amount": 100000.0},
    ]
    failed = [r["failed_rules"] for r in quality.tag_failures(frame(spark, *bad)).collect()]
    assert failed == [
        ["amount_range"], ["amount_range"], ["amount_present"], ["hour_range"], ["day_range"],
        ["velocity_range"], ["ratio_positive"], ["created_at_present"], ["event_id_present"], [],
    ]
    valid, quarantined = quality.split_valid(frame(spark, *bad))
    assert valid.count() == 1 and quarantined.count() == 9


def test_valid_rows_are_told_by_plain_conditions(spark):
    """No list of broken rules is made for rows that break none; a rule that is null counts as broken."""
    rows = [{"amount": 5.0}, {"amount": None}, {"amount": -1.0, "hour_of_day": 30}]
    valid, quarantined = quality.split_valid(frame(spark, *rows))
    assert "lambda" not in valid._jdf.queryExecution().optimizedPlan().toString()
    assert [r["amount"] for r in valid.collect()] == [5.0] and "failed_rules" not in valid.columns
    assert [r["failed_rules"] for r in quarantined.collect()] == [["amount_present"], ["amount_range", "hour_range"]]


def test_malformed_payload_is_quarantined(spark):
    raw = spark.createDataFrame(
        [("not json",), ('{"txn_id": "1", "account_id": "a", "amount": 5, "created_at": "never", "event_id": "e"}',)],
        "value string",
    )
    parsed = staging.parse_payload(raw)
    valid, bad = quality.split_valid(parsed)
    assert valid.count() == 0
    assert {tuple(r["failed_rules"]) for r in bad.collect()} >= {("created_at_present",)}


def test_payload_round_trip(spark):
    sent = frame(spark, {})
    got = staging.parse_payload(staging.to_payload(sent)).first()
    assert got["txn_id"] == "t" and got["amount"] == 50.0 and got["created_at"] == BASE["created_at"]
    again = staging.parse_payload(staging.to_payload(sent)).first()
    assert got["event_id"] == again["event_id"]


def test_unseen_category_and_missing_fields(spark):
    rows = frame(spark, {"merchant_category": "unseen", "amount": None, "amount_vs_avg_ratio": None})
    scored = scoring.linear_scores(rows).first()
    assert scored["amount"] == 0.0 and scored["amount_vs_avg_ratio"] == 1.0
    assert scored["raw_probability"] == pytest.approx(1 / (1 + 2.718281828459045 ** (2.2 - 0.25)))


def test_what_if_is_monotone(spark):
    scored = scoring.linear_scores(frame(spark, {"txn_velocity_1h": 1}))
    scenarios = [
        {"name": "burst", "txn_velocity_1h": 15},
        {"name": "foreign", "is_foreign_merchant": 1},
        {"name": "wire", "merchant_category": "wire_transfer"},
    ]
    assert all(r["score_delta"] >= 0 for r in explain.what_if(scored, scenarios).collect())


def test_counterfactual_solutions_and_fallback(spark):
    flagged = scoring.linear_scores(frame(spark, {"amount": 260.0}, {"txn_id": "u", "amount": 100.0, "amount_vs_avg_ratio": 80.0}))
    rows = explain.counterfactuals(flagged).orderBy("txn_id", "position").collect()
    solved = [r for r in rows if r["txn_id"] == "t"]
    assert len(solved) == 3 and solved[0]["n_changes"] == 1 and solved[0]["changes"].startswith("amount=")
    assert all(r["target_risk_score"] < 50 for r in solved)
    stuck = [r for r in rows if r["txn_id"] == "u"]
    assert len(stuck) == 1 and stuck[0]["is_fallback"] and stuck[0]["target_risk_score"] == 35.0


def test_five_attributions_add_up(spark):
    scored = scoring.linear_scores(frame(spark, {}, {"txn_id": "u", "amount": 400.0, "txn_velocity_1h": 4}))
    attributed = scoring.attributions(scored)
    for row in attributed.collect():
        assert len(row["attributions"]) == 7
    top = scoring.top_attributions(attributed).collect()
    assert all(len(r["top_features"]) == 5 for r in top)
    first, second = (sum(a["value"] for a in r["attributions"]) for r in attributed.collect())
    assert first == pytest.approx(-second)


def test_summary_of_nothing_is_one_row(spark):
    scores = scoring.risk_scores(scoring.linear_scores(frame(spark, {})), F.col("created_at"))
    row = risk.summary(scores, F.lit("2030-01-01").cast("timestamp")).first()
    assert row["total_scored_today"] == 0 and row["fraud_count"] is None and row["fraud_rate_pct"] is None


def test_search_checks_its_arguments(spark):
    scores = scoring.risk_scores(scoring.linear_scores(frame(spark, {})), F.col("created_at"))
    now = F.lit("2024-01-03").cast("timestamp")
    assert risk.search(scores, now).count() == 1
    for wrong in ({"limit": 501}, {"hours_back": 0}, {"min_score": -1}, {"decision": "MAYBE"}):
        with pytest.raises(ValueError):
            risk.search(scores, now, **wrong)


def test_criteria_pick_the_first_match(spark):
    scores = scoring.risk_scores(scoring.linear_scores(frame(spark, {}, {"txn_id": "u", "account_id": "b"})), F.col("created_at"))
    now = F.lit("2024-01-03").cast("timestamp")
    assert [r["txn_id"] for r in risk.by_criteria(scores, "account: b", now).collect()] == ["u"]
    assert risk.by_criteria(scores, "Fraud in review", now).count() == 0
    assert risk.by_criteria(scores, "top 10 riskiest today", now).count() == 2


def test_disallowed_and_orphans(spark):
    child = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    parent = spark.createDataFrame([("1",)], "k string")
    assert quality.orphan_count(child, parent, "k", "fk").first()["violations"] == 1
    assert [r["k"] for r in quality.disallowed_values(child, "k", ["1"]).collect()] == ["2"]


def test_bureau_signal_is_stable_and_bounded(spark):
    df = spark.createDataFrame([(str(i),) for i in range(200)], "account_id string")
    one = [r[0] for r in df.select(credit.bureau_signal(F.col("account_id"))).collect()]
    two = [r[0] for r in df.select(credit.bureau_signal(F.col("account_id"))).collect()]
    assert one == two and 0 <= min(one) and max(one) < 0.3


def test_fixed_values():
    assert len(CATEGORIES) == 13 and CATEGORIES[0] == "grocery" and max(CATEGORY_BASE_RATES.values()) == 0.095
