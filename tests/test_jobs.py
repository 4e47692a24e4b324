"""Whole jobs over a warehouse folder, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from riskweave import dataset
from riskweave.__main__ import main
from riskweave.operators.keyed import first_of_stored, first_write_wins
from riskweave.plans import features, governance, jobs, questions, risk, wide
from riskweave.sinks.warehouse import Warehouse


@pytest.fixture(scope="module")
def warehouse(spark, sf_dir, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    txns = dataset.transactions(spark, sf_dir).withColumn("event_id", F.col("txn_id"))
    txns = txns.drop("account_type", "age_days", "avg_monthly_spend", "region", "is_high_risk")
    for _ in range(2):  # the second load changes nothing
        jobs.load(house, txns, dataset.accounts(spark, sf_dir), dataset.merchants(spark, sf_dir))
    return house


def test_load_stage_score(spark, sf_dir, warehouse):
    n = dataset.base_transactions(spark, sf_dir).count()
    assert warehouse.read("raw.transactions").count() == n
    quarantined = jobs.stage(warehouse)
    bad = quarantined.count()
    assert warehouse.read("staging.transactions").count() == n - bad
    rows = warehouse.read("staging.transactions")
    for _ in range(2):
        alerts = jobs.score(warehouse, rows, F.col("created_at"))
    assert warehouse.read("mart.risk_scores").count() == n - bad
    assert warehouse.read("audit.model_decisions").count() == 2 * (n - bad)
    assert alerts.count() == warehouse.read("mart.risk_scores").filter("composite_risk_score > 75").count()
    scores = warehouse.read("mart.risk_scores")
    decisions = warehouse.read("audit.model_decisions").distinct()
    joined = scores.join(decisions.select("txn_id", "score", F.col("decision").alias("d")), "txn_id")
    assert joined.filter("abs(score - composite_risk_score) > 0.01 or d <> decision").isEmpty()


def test_look_back_reads_only_its_days(warehouse):
    since = dataset.as_of() - F.expr("INTERVAL 24 HOURS")
    recent = warehouse.read("raw.transactions", since=since)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert risk.label_rate(recent).first()["total"] < warehouse.read("raw.transactions").count()


def test_drift_and_gate_are_recorded(warehouse):
    report = jobs.monitor_drift(warehouse, "2024-01-31 00:00:00", 0.2)
    assert report.count() == 5 and warehouse.read("audit.drift_reports").count() == 5
    assert governance.latest_drift(warehouse.read("audit.drift_reports")).count() == 5


def test_command_line(warehouse):
    root = ["--warehouse", warehouse.root]
    jobs.stage(warehouse)
    assert main([*root, "drift", "--as-of", "2024-01-31 00:00:00"]) in (0, 1)
    gate = [*root, "fairness", "--as-of", "2024-01-31 00:00:00"]
    loose = [f"--threshold-{m}=1.0" for m in ("demographic-parity", "equal-opportunity", "predictive-parity")]
    assert main(gate + loose) == 0
    assert main([*gate, "--threshold-demographic-parity=-1.0"]) == 1
    assert main([*gate, "--threshold-demographic-parity=-1.0", "--hitl", "analyst"]) == 0
    assert warehouse.read("audit.fairness_overrides").count() == 1
    assert warehouse.read("audit.fairness_reports").count() == 3


def test_overrides(spark, warehouse):
    cols = "txn_id string, original_decision string, override_decision string, analyst_id string, justification string, overridden_at timestamp"
    one = spark.createDataFrame([("1", "FRAUD", "CLEAR", "x", "known customer", None)], cols)
    jobs.override_decisions(warehouse, one.withColumn("overridden_at", F.lit("2024-02-01").cast("timestamp")))
    assert warehouse.read("audit.hitl_overrides").count() == 1


def test_names_and_missing_tables(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    with pytest.raises(ValueError):
        house.path("other.table")
    with pytest.raises(LookupError):
        house.read("raw.transactions")
    assert not house.exists("raw.accounts")


def test_rejected_rows_are_stored_once(spark, warehouse, tmp_path):
    """Rows without an id or with a bad amount, however often they come and are staged."""
    house = Warehouse(spark, str(tmp_path))
    good = warehouse.read("raw.transactions").limit(5)
    bad = good.limit(3).withColumn("amount", -F.col("amount")).withColumn("txn_id", F.when(F.col("hour_of_day") >= 0, F.lit(None).cast("string")))
    house.append("raw.transactions", good.unionByName(bad).unionByName(bad))
    for _ in range(2):
        assert jobs.stage(house).count() == 6
    stored = house.read("audit.rejected_transactions").collect()
    assert len(stored) == len({r["reject_id"] for r in stored}) == 3
    assert all({"txn_id_present", "amount_range"} <= set(r["failed_rules"]) and json.loads(r["row"])["amount"] < 0 for r in stored)


def rounded_rows(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_read_only_their_days(spark, warehouse, sf_dir, capsys):
    """Every look-back shows as a partition filter, and gives what the whole mart gives."""
    jobs.stage(warehouse)
    jobs.score(warehouse, warehouse.read("staging.transactions"), F.col("created_at"))
    now, mart = dataset.as_of(), warehouse.read("mart.risk_scores")
    asked = {
        "summary": (questions.summary(warehouse, now), risk.summary(mart, now)),
        "trend": (questions.weekly_trend(warehouse, now, 2), risk.weekly_trend(mart, now, 2)),
        "search": (questions.search(warehouse, now, 48, min_score=40), risk.search(mart, now, 40, 100, None, 48)),
        "top": (questions.top_riskiest(warehouse, now), risk.top_riskiest(mart, now)),
        "newest": (questions.newest(warehouse, now, 30), risk.newest(mart.filter(F.col("scored_at") <= now), None, 30)),
    }
    for name, (got, want) in asked.items():
        assert "PartitionFilters: [isnotnull(day" in plan_of(got), name
        assert rounded_rows(got) == rounded_rows(want), name
    since = now - F.expr("INTERVAL 2 DAYS")
    velocity = questions.recent_velocity(warehouse, since)
    whole = features.trailing_velocity(warehouse.read("raw.transactions")).filter(F.col("created_at") >= since)
    assert "PartitionFilters: [isnotnull(day" in plan_of(velocity)
    pick = lambda df: sorted((r["txn_id"], r["txn_velocity_1h"]) for r in df.collect())
    assert pick(velocity) == pick(whole) != []
    with pytest.raises(ValueError):
        questions.ask(warehouse, "weather", dataset.AS_OF)
    capsys.readouterr()
    assert main(["--warehouse", warehouse.root, "ask", "search", "--as-of", dataset.AS_OF, "--hours-back", "48", "--min-score", "40", "--limit", "7"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["txn_id"] for x in lines] == [r["txn_id"] for r in asked["search"][1].limit(7).collect()]


def test_newest_of_a_short_mart(spark, tmp_path):
    """The look-back grows until it has enough rows, or the first day is reached."""
    house = Warehouse(spark, str(tmp_path))
    rows = [(str(i), f"2024-01-{d:02d} 10:00:00", "FRAUD" if d == 3 else "CLEAR") for i, d in enumerate([3, 3, 20, 30])]
    mart = spark.createDataFrame(rows, "txn_id string, at string, decision string").selectExpr("txn_id", "decision", "to_timestamp_ntz(at) AS scored_at")
    house.append("mart.risk_scores", mart)
    now = dataset.as_of()
    assert [r["txn_id"] for r in questions.newest(house, now, 2).collect()] == ["3", "2"]
    assert [r["txn_id"] for r in questions.newest_fraud(house, now, 9).collect()] == ["0", "1"]
    assert questions.newest(house, F.lit("2023-01-01").cast("timestamp_ntz"), 3).count() == 0


@pytest.mark.parametrize("most", [0, 2, 10_000])
def test_first_of_stored_agrees_with_first_write_wins(spark, most):
    """Repeated, missing and known keys, whether few or many are new; a batch of single keys moves no rows."""
    rows = [(f"k{i % 40}" if i % 13 else None, i, "x" * 50) for i in range(60)]
    batch = spark.createDataFrame(rows, "id string, at int, body string")
    for known in (None, [], ["k1", "k7", None], [f"k{i}" for i in range(40)]):
        target = None if known is None else spark.createDataFrame([(k,) for k in known], "id string")
        got, want = (f(batch, target, ["id"], [F.col("at")], **more) for f, more in ((first_of_stored, {"most": most}), (first_write_wins, {})))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    single = first_of_stored(batch.where("id IS NOT NULL").dropDuplicates(["id"]).localCheckpoint(), None, ["id"], [F.col("at")])
    if most:
        plan = single._jdf.queryExecution().optimizedPlan().toString()
        assert single.count() == 38 and "LeftAnti" in plan and "LeftSemi" in plan  # only the rows that share a key are ranked


def test_blobs_are_parsed_as_named_fields(spark):
    """One parse for all features; what a blob lacks, or holds as null, is the sentinel, and a key that nobody asks for may be no number."""
    packed = spark.createDataFrame([("a", '{"V1":1.5,"V2":null}'), ("b", '{"V2":-3,"note":"x"}'), ("c", None)], "TransactionID string, features_json string")
    opened = wide.unpack(packed, ["V1", "V2", "V1"])
    assert sorted(map(tuple, opened.collect())) == [("a", 1.5, -999.0), ("b", -999.0, -3.0), ("c", -999.0, -999.0)]
    assert wide.unpack(packed, ["V2"], fill=False).where("TransactionID = 'b'").first()["V2"] == -3.0
    assert "map<" not in opened._jdf.queryExecution().optimizedPlan().toString().lower()
    assert wide.unpack(packed, []).columns == ["TransactionID"]
