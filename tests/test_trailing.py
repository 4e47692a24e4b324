"""Trailing sums against brute force, with ties, borders and a hot key."""

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators import trailing
from riskweave.operators.trailing import DAY, HOUR, MINUTE, Span, trailing_moments, trailing_sums
from riskweave.plans import features

START = datetime(2024, 1, 1)


def rows_of(n, seed, keys=("a", "a", "a", "b", None)):
    rng = random.Random(seed)
    step = [timedelta(minutes=rng.choice([0, 1, 15, 30, 59, 60, 61, 119, 240])) for _ in range(n)]
    at, out = START, []
    for i in range(n):
        at = at + step[i] if i % 7 else START + timedelta(hours=rng.randrange(48))
        out.append((str(i), rng.choice(keys), at, float(rng.randrange(1, 100)) if i % 11 else None))
    return out


@pytest.mark.parametrize("bucket", [HOUR, 30 * MINUTE, 10 * MINUTE])
@pytest.mark.parametrize("strict", [True, False])
def test_matches_brute_force(spark, bucket, strict):
    data = rows_of(300, seed=bucket + strict)
    df = spark.createDataFrame(data, "id string, key string, at timestamp, x double")
    spans = [Span("short", HOUR, ("n", "x"), strict), Span("long", 5 * HOUR, ("x",), strict)]
    measures = {"n": F.lit(1), "x": F.col("x")}
    got = {r["id"]: r for r in trailing_sums(df, ["key"], "at", measures, spans, bucket).collect()}
    assert len(got) == len(data)
    for row_id, key, at, _ in data:
        for span, length in (("short", timedelta(hours=1)), ("long", timedelta(hours=5))):
            frame = [
                r for r in data if r[1] == key and r[2] <= at and (at - r[2] < length if strict else at - r[2] <= length)
            ]
            assert got[row_id][f"{span}_x"] == pytest.approx(sum(r[3] or 0 for r in frame))
            if span == "short":
                assert got[row_id]["short_n"] == len(frame)


def test_rows_without_a_time_keep_a_null(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", "a", START)], "txn_id string, account_id string, created_at timestamp")
    got = {r["txn_id"]: r["txn_velocity_1h"] for r in features.trailing_velocity(df).collect()}
    assert got == {"1": None, "2": 0}


def test_before_1970(spark):
    at = [datetime(1969, 12, 31, 23, 50), datetime(1970, 1, 1, 0, 10), datetime(1970, 1, 1, 0, 50)]
    df = spark.createDataFrame([(str(i), "a", t) for i, t in enumerate(at)], "txn_id string, account_id string, created_at timestamp")
    got = {r["txn_id"]: r["txn_velocity_1h"] for r in features.trailing_velocity(df).collect()}
    assert got == {"0": 0, "1": 1, "2": 1}


def test_span_must_fit_buckets(spark):
    df = spark.createDataFrame([("a", START)], "key string, at timestamp")
    with pytest.raises(ValueError):
        trailing_sums(df, ["key"], "at", {"n": F.lit(1)}, [Span("s", HOUR, ("n",))], 7 * MINUTE)


def test_hot_key_spreads_over_tasks(spark):
    """One account with all rows is split by time before any sort."""
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("txn_id"),
        F.lit("hot").alias("account_id"),
        (F.lit(START).cast("timestamp") + F.expr("make_dt_interval(0, 0, id)")).alias("created_at"),
    )
    out = features.trailing_velocity(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("hashpartitioning(")[1][:80]
    counts = out.groupBy("txn_velocity_1h").count().collect()
    # one row a minute: 59 earlier rows fit in an open hour
    assert max(r["txn_velocity_1h"] for r in counts) == 59


def test_velocity_band_reaches_its_top(spark):
    rows = [(str(i), "a", START + timedelta(seconds=20 * i)) for i in range(7)]
    df = spark.createDataFrame(rows, "txn_id string, account_id string, created_at timestamp")
    scores = {r["velocity_score"] for r in features.account_velocity(df).collect()}
    assert scores == {0.0, 1.0} or scores == {0.0, 0.5, 1.0}
    assert max(r["txn_velocity_1h"] for r in features.trailing_velocity(df).collect()) == 6


def test_single_row_has_no_deviation(spark):
    df = spark.createDataFrame([("1", "a", START, 5.0)], "txn_id string, account_id string, created_at timestamp, amount double")
    assert features.account_daily_amounts(df).first()["amount_std_24h"] is None
    assert features.amount_zscore(df).first()["amount_zscore_30d"] is None


def test_constant_amounts_have_no_zscore(spark):
    rows = [(str(i), "a", START + timedelta(hours=i), 0.1) for i in range(50)]
    df = spark.createDataFrame(rows, "txn_id string, account_id string, created_at timestamp, amount double")
    assert all(r["amount_zscore_30d"] is None for r in features.amount_zscore(df).collect())


def test_zscore_does_not_depend_on_magnitude(spark):
    scores = []
    for base in (1_000.0, 1_000_000.0, 1e9):
        rows = [(str(i), "a", START + timedelta(hours=i), base + 0.5 * (i % 7)) for i in range(30)]
        df = spark.createDataFrame(rows, "txn_id string, account_id string, created_at timestamp, amount double")
        scores.append({r["txn_id"]: r["amount_zscore_30d"] for r in features.amount_zscore(df).collect()})
    assert scores[0]["29"] is not None
    for other in scores[1:]:
        assert {k: None if v is None else round(v, 6) for k, v in other.items()} == {
            k: None if v is None else round(v, 6) for k, v in scores[0].items()
        }


def test_unknown_accounts_stay(spark):
    txns = spark.createDataFrame([("1", "a"), ("2", "nobody")], "txn_id string, account_id string")
    accounts = spark.createDataFrame([("a", 10)], "account_id string, age_days int")
    assert features.with_accounts(txns, accounts).count() == 2
    assert features.with_accounts(txns, accounts, "inner").count() == 1


def test_zscore_far_from_earlier_amounts(spark):
    """Amounts around 5 score like any others, whatever the account did long before; so do they at other magnitudes."""
    old = [(f"o{i}", "a", 1e9, START - timedelta(days=200 - i)) for i in range(20)]
    recent = [(f"r{i}", "a", 5.0 + 0.002 * i, START + timedelta(hours=i)) for i in range(11)]
    df = spark.createDataFrame(old + recent, "txn_id string, account_id string, amount double, created_at timestamp_ntz")
    got = {r["txn_id"]: r for r in features.amount_zscore(df).collect()}
    values = [a for _, _, a, _ in recent]
    for i in range(1, 11):
        mean, deviation = statistics.mean(values[: i + 1]), statistics.stdev(values[: i + 1])
        assert got[f"r{i}"]["amount_zscore_30d"] == pytest.approx((values[i] - mean) / deviation, rel=1e-6)
        assert got[f"r{i}"]["amount_mean_30d"] == pytest.approx(mean, rel=1e-12)
    assert got["r0"]["amount_zscore_30d"] is None and got["o5"]["amount_zscore_30d"] is None


def test_moments_against_plain_frames(spark):
    """n, mean, squares, least and most of every frame, with nulls, ties, hours and days between, and frames without values."""
    rng = random.Random(11)
    rows = [(i, rng.choice("ab"), START + timedelta(minutes=rng.choice([0, 0, 1, 60, 61]) + 60 * rng.randrange(24 * 70)), rng.choice([None, 1e6 + rng.random(), 3.0])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, key string, at timestamp_ntz, x double")
    spans = [Span("s", 30 * DAY, ("x",)), Span("t", 2 * HOUR, ("x",), strict=True), Span("u", 3 * DAY + 5 * HOUR, ("x",)), Span("w", DAY, ("x",))]
    got = {r["id"]: r for r in trailing_moments(df, ["key"], "at", {"x": F.col("x")}, spans, HOUR).collect()}
    assert len(got) == len(rows)
    for i, key, at, _ in rows:
        for s in spans:
            width = timedelta(microseconds=s.length)
            held = [x for _, k, t, x in rows if k == key and x is not None and (at - width < t if s.strict else at - width <= t) and t <= at]
            m = got[i][f"{s.name}_x"]
            assert m["n"] == len(held)
            if held:
                assert m["whole"] + m["rest"] == pytest.approx(statistics.fmean(held)) and (m["least"], m["most"]) == (min(held), max(held))
                assert m["squares"] == pytest.approx(statistics.pvariance(held) * len(held), rel=1e-6, abs=1e-6)


def test_no_frame_slides_over_hours(spark):
    """A span of 90 days is found from totals of days; the widest frame that is added up anew has fewer entries than the span has days."""
    df = spark.createDataFrame([("1", "a", 1.0, START)], "txn_id string, account_id string, amount double, created_at timestamp_ntz")
    plan = features.amount_vs_trailing_average(df)._jdf.queryExecution().analyzed().toString()
    frames = [int(n) for n in re.findall(r"RangeFrame, (?:cast\()?-(\d+)", plan, re.I)]
    assert frames and max(frames) < 90


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A task sorts so many rows at most, and more rows make more tasks; the results are the same."""
    data = rows_of(400, seed=5, keys=("a", "b"))
    df = spark.createDataFrame(data, "txn_id string, account_id string, created_at timestamp_ntz, amount double")
    # amounts at the same instant are added up in any order: the last digit may differ
    def rounded(out):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.collect())

    for feature in (features.amount_zscore, features.trailing_counts):
        plain = rounded(feature(df))
        monkeypatch.setattr(trailing, "TASK_ROWS", 40)
        dealt = feature(df)
        assert dealt.rdd.getNumPartitions() >= 400 * 3 // 40
        assert rounded(dealt) == plain
        monkeypatch.undo()


@pytest.mark.parametrize("strict", [True, False])
def test_counts_of_spans_shorter_than_a_bucket(spark, strict):
    """Whole numbers over minutes, an hour and days in one pass, up to the microsecond at a bucket's border; one order of the rows is enough."""
    data = rows_of(250, seed=3) + [(f"e{i}", "a", START + timedelta(hours=5, microseconds=i), 1.0) for i in (-60_000_001, -60_000_000, -1, 0, 1, 60_000_000)]
    df = spark.createDataFrame(data, "id string, key string, at timestamp, x double")
    lengths = {"short": timedelta(minutes=1), "half": timedelta(minutes=37), "hour": timedelta(hours=1), "long": timedelta(days=2)}
    spans = [Span(name, length // timedelta(microseconds=1), ("n", "odd"), strict) for name, length in lengths.items()]
    odd = F.when(F.col("x").isNotNull(), F.col("x").cast("int") % 2)
    out = trailing_sums(df, ["key"], "at", {"n": F.lit(1), "odd": odd}, spans, HOUR)
    assert "DESC" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(data)
    for row_id, key, at, _ in data:
        for name, length in lengths.items():
            frame = [r for r in data if r[1] == key and r[2] <= at and (at - r[2] < length if strict else at - r[2] <= length)]
            assert got[row_id][f"{name}_n"] == len(frame)
            assert (got[row_id][f"{name}_odd"] or 0) == sum(int(r[3]) % 2 for r in frame if r[3] is not None)
