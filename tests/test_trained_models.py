"""Boosted trees, searches, bundles and the commands that train and score with them."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave import dataset
from riskweave.__main__ import main
from riskweave.operators import boosting
from riskweave.operators.boosting import Settings
from riskweave.plans import credit, models
from riskweave.schemas import CREDIT_DESCRIPTIONS, CREDIT_FEATURES, SEARCH_SPACES
from riskweave.sinks.warehouse import Warehouse


def points_and_labels(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random(n) < 0.02, 2] = np.nan
    z = 2 * x[:, 0] + np.where(x[:, 1] > 0, 1, -1) * x[:, 3] - 1
    return x, z, (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)


NAMES = ["a", "b", "c", "d"]


def test_auc_counts_pairs():
    rng = random.Random(1)
    for _ in range(20):
        score = np.array([rng.choice([0.1, 0.2, 0.3, 0.7]) for _ in range(60)])
        label = np.array([rng.random() < 0.4 for _ in range(60)]).astype(float)
        good, bad = score[label == 1], score[label == 0]
        want = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
        assert boosting.auc(score, label) == pytest.approx(want)
    assert np.isnan(boosting.auc(np.ones(3), np.ones(3)))


@pytest.mark.parametrize("settings", [Settings(n_estimators=80), Settings(n_estimators=80, subsample=1.0, colsample_bytree=0.5, reg_alpha=0.5, max_depth=3, scale_pos_weight=5)])
def test_boosting_learns_interactions(settings):
    x, z, y = points_and_labels(4000)
    model = boosting.fit(x[:3000], y[:3000], NAMES, True, settings)
    guess, moves = model.margins(x[3000:], paths=True)
    best = boosting.auc(z[3000:], y[3000:])
    assert boosting.auc(guess, y[3000:]) > best - 0.03
    assert np.allclose(model.expected() + moves.sum(axis=1), guess)
    assert np.abs(moves[:, 2]).mean() < np.abs(moves[:, 0]).mean() / 5  # the third feature says nothing


def test_boosting_fits_numbers_and_depends_on_the_rows_only():
    x, z, _ = points_and_labels(3000, 5)
    one, two = (boosting.fit(x[:2500], z[:2500], NAMES, False, Settings(n_estimators=150)) for _ in range(2))
    assert all(np.array_equal(getattr(one, n), getattr(two, n)) for n in ("feature", "threshold", "value"))
    assert np.abs(one.margins(x[2500:])[0] - z[2500:]).mean() < 0.3 * np.abs(z[2500:] - z.mean()).mean()


def test_boosting_without_anything_to_split():
    same = boosting.fit(np.ones((50, 2)), np.arange(50) % 2.0, ["a", "b"], True, Settings(n_estimators=5, subsample=1.0))
    assert (same.feature == -1).all() and same.margins(np.array([[1.0, np.nan]]))[0][0] == pytest.approx(0.0)
    empty = boosting.fit(np.full((4, 1), np.nan), np.ones(4), ["a"], False, Settings(n_estimators=0))
    assert empty.margins(np.zeros((2, 1)))[0].tolist() == [1.0, 1.0] and empty.expected() == 1.0


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("a"), F.when(F.col("id") > 9, F.col("id") % 2).alias("y"))
    one = boosting.sample_rows(df, "k", ["a"], "y", 100)
    assert len(one) == 100 and one.equals(boosting.sample_rows(df.repartition(7), "k", ["a"], "y", 100)) and one["_label"].notna().all()


def test_trials_stay_in_their_space():
    for kind, space in SEARCH_SPACES.items():
        drawn = models.draw_trials(kind, 40)
        assert drawn == models.draw_trials(kind, 40) and len({t.learning_rate for t in drawn}) == 40
        assert all(low <= getattr(t, name) <= high for t in drawn for name, (low, high, _) in space.items())


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    path = dataset.transactions(spark, sf_dir).withColumn("account_age_days", F.col("age_days"))
    return models.materialize(path, "test-rows")


@pytest.fixture(scope="module")
def bundles(rows):
    fast = Settings(n_estimators=40, max_depth=3)
    return {
        "fraud": models.train(rows, "fraud", fast, sample=700),
        "credit": models.train(rows, "credit", fast, sample=700),
        "anomaly": models.train_forest(rows, trees=30, sample=64),
    }


def score(rows, bundle, bundles):
    if bundle.kind == "fraud":
        return models.fraud_scores(rows, bundle, explain=True)
    if bundle.kind == "anomaly":
        return models.anomaly_scores(rows, bundle)
    return models.credit_scores(rows, bundle, bundles["anomaly"])


@pytest.mark.parametrize("kind", ["fraud", "credit", "anomaly"])
def test_bundles_score_the_same_after_loading(spark, rows, bundles, tmp_path, kind):
    path = f"{tmp_path}/{kind}"
    models.save(bundles[kind], path)
    loaded = models.load(spark, path)
    before, after = (score(rows, b, bundles).select("txn_id", *score(rows, b, bundles).columns[-4:]).orderBy("txn_id").collect() for b in (bundles[kind], loaded))
    assert before == after and loaded.about == json.loads(json.dumps(bundles[kind].about))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        models.save(bundles[kind], path)


def test_loading_refuses_what_does_not_fit(spark, bundles, tmp_path, monkeypatch):
    with pytest.raises(LookupError):
        models.load(spark, f"{tmp_path}/nothing")
    for name, change in (("features", {"features": ["amount"]}), ("cutoffs", {"cutoffs": {"fraud": 1}}), ("format", {"format": 99})):
        bundle = bundles["fraud"]
        odd = models.Bundle(bundle.kind, bundle.model, bundle.codes, {**bundle.about, **change})
        models.save(odd, f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            models.load(spark, f"{tmp_path}/{name}")


def test_scores_leave_the_rows_alone(spark, rows, bundles):
    """Missing features are filled for the score only, each model with its own defaults; an unseen category counts as code 0."""
    odd = rows.limit(20).withColumns({"amount": F.lit(None).cast("double"), "merchant_category": F.lit("never seen")})
    first = bundles["fraud"].codes.where("code = 0").first()["value"]
    known = odd.withColumns({"amount": F.lit(0.0), "merchant_category": F.lit(first)})
    one, two = (models.fraud_scores(x, bundles["fraud"]).orderBy("txn_id").collect() for x in (odd, known))
    assert [r["raw_probability"] for r in one] == [r["raw_probability"] for r in two] and all(r["amount"] is None for r in one)
    both = models.with_credit(models.fraud_scores(odd, bundles["fraud"]), bundles["credit"], bundles["anomaly"])
    alone = models.credit_scores(odd, bundles["credit"], bundles["anomaly"])
    pick = lambda df: sorted((r["txn_id"], r["credit_risk_score"], r["risk_band"]) for r in df.collect())
    assert pick(both) == pick(alone)


def test_credit_score_is_composed(rows, bundles):
    got = models.credit_scores(rows, bundles["credit"], bundles["anomaly"]).withColumn("bureau", credit.bureau_signal(F.col("account_id")))
    got = got.withColumn("_anomaly", F.col("anomaly_component")).collect()
    assert len({r["credit_risk_score"] for r in got}) > 20
    for r in got:
        again = 50 * r["model_component"] + 35 * r["anomaly_component"] + 15 * r["bureau"]
        assert r["credit_risk_score"] == pytest.approx(again, abs=0.011) and r["bureau_component"] == round(r["bureau"], 4)
        top = [f["feature"] for f in r["top_features"]]
        assert len(top) == 5 and set(top) <= set(CREDIT_FEATURES) and all(f["description"] == CREDIT_DESCRIPTIONS[f["feature"]] for f in r["top_features"])


def test_attributions_add_up_to_the_log_odds(rows, bundles):
    model = bundles["fraud"].model
    for r in models.fraud_scores(rows, bundles["fraud"], explain=True).limit(50).collect():
        total = model.expected() + sum(a["value"] for a in r["attributions"])
        assert 1 / (1 + np.exp(-total)) == pytest.approx(r["raw_probability"])


def test_search_prefers_what_generalises(spark, rows):
    split = models.materialize(models.labelled(rows, "credit"), "test-search")
    codes = models.fit_codes(split, ["merchant_category"])
    space = [Settings(n_estimators=1, learning_rate=0.001), Settings(n_estimators=60, max_depth=3), Settings(n_estimators=0)]
    found = models.search(models.prepared(split, "credit", codes), "credit", space=space)
    assert [t["trial"] for t in found][0] == 1 and found[0]["score"] > found[1]["score"] >= found[2]["score"]
    with pytest.raises(ValueError):
        models.search(models.prepared(split.where("split = 'train'"), "credit", codes), "credit", space=space)


def test_commands_train_and_score(spark, sf_dir, tmp_path, capsys):
    house = Warehouse(spark, f"{tmp_path}/house")
    raw = dataset.transactions(spark, sf_dir).withColumn("event_id", F.col("txn_id")).drop("account_type", "age_days", "avg_monthly_spend", "region", "is_high_risk")
    for name, df in (("transactions", raw), ("accounts", dataset.accounts(spark, sf_dir)), ("merchants", dataset.merchants(spark, sf_dir))):
        df.write.parquet(f"{tmp_path}/{name}")
    at = ["--warehouse", house.root]
    assert main([*at, "load", *[x for n in ("transactions", "accounts", "merchants") for x in (f"--{n}", f"{tmp_path}/{n}")]]) == 0
    assert main([*at, "stage"]) == 0
    for kind in ("fraud", "credit", "anomaly"):
        capsys.readouterr()
        extra = [] if kind == "anomaly" else ["--trials", "0", "--sample", "500"]
        assert main([*at, "train", kind, "--out", f"{tmp_path}/models/{kind}", *extra]) == 0
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["kind"] == kind
    with pytest.raises(SystemExit):
        main([*at, "score", "--model", f"{tmp_path}/models/fraud", "--credit-model", f"{tmp_path}/models/credit"])
    bundle_options = [x for k, o in (("fraud", "--model"), ("credit", "--credit-model"), ("anomaly", "--anomaly-model")) for x in (o, f"{tmp_path}/models/{k}")]
    assert main([*at, "score", *bundle_options]) == 0
    mart = house.read("mart.risk_scores")
    bundle = models.load(spark, f"{tmp_path}/models/fraud")
    want = {r["txn_id"]: r["fraud_probability"] for r in models.fraud_scores(house.read("staging.transactions"), bundle).collect()}
    got = mart.collect()
    assert got and all(r["credit_risk_score"] is not None and r["fraud_probability"] == want[r["txn_id"]] for r in got)
    explained = json.loads(house.read("audit.explanations").first()["top_features"])
    assert len(explained) == 5 and all(f["direction"] in ("increases_risk", "decreases_risk") for f in explained)


def wide_files(spark, folder, first, last):
    """Two CSV files with a column that says nothing, one with gaps, and a label that follows the amount."""
    rows = [(i, int(i % 10 > 6), 3600 * i, 10.0 * (i % 10) + 1, ["W", "C", "H"][i % 3], "credit" if i % 2 else None, None if i % 4 else 7.0, 1.0) for i in range(first, last)]
    names = "TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, ProductCD string, card6 string, dist1 double, V1 double"
    spark.createDataFrame(rows, names).coalesce(1).write.csv(f"{folder}/transactions", header=True)
    spark.createDataFrame([(i, float(i % 5)) for i in range(first, last, 2)], "TransactionID long, id_01 double").coalesce(1).write.csv(f"{folder}/identity", header=True)
    return ["--transactions", f"{folder}/transactions", "--identity", f"{folder}/identity"]


def test_wide_load_and_model(spark, tmp_path, capsys):
    """The load inserts each row once, later loads keep codes and columns of the first; the model scores them and loads back."""
    house = Warehouse(spark, f"{tmp_path}/house")
    at = ["--warehouse", house.root]
    one, two = (wide_files(spark, f"{tmp_path}/{i}", a, b) for i, (a, b) in enumerate([(0, 400), (200, 600)]))
    for files, total in ((one, 400), (one, 400), (two, 600)):
        capsys.readouterr()
        assert main([*at, "load-wide", *files]) == 0
        report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert report["total"] == total and report["fraud_count"] == 0.3 * total
    table = house.read("raw.wide_transactions")
    assert "V1" not in models.wide.packed_keys(table) and table.filter("ProductCD NOT BETWEEN 0 AND 2").isEmpty()
    assert main([*at, "train", "wide", "--out", f"{tmp_path}/model", "--trials", "0", "--sample", "300"]) == 0
    bundle = models.load(spark, f"{tmp_path}/model")
    assert bundle.about["features"][0] == "TransactionAmt" and "id_01" in bundle.about["features"]
    scored = models.wide_scores(table, bundle)
    assert scored.columns[: len(table.columns)] == table.columns
    assert scored.filter("predicted_fraud <> (isFraud = 1)").count() < 0.02 * 600
    # a table without some of the features: they count as missing
    assert models.wide_scores(table.drop("dist1", "email_match"), bundle).count() == 600


def test_details_of_counterfactuals(rows):
    from riskweave.plans import explain, scoring

    scored = scoring.linear_scores(rows)
    whole = {(r["txn_id"], r["position"]): r for r in explain.counterfactuals(scored).collect()}
    parts = {}
    for r in explain.counterfactual_details(scored).collect():
        parts.setdefault((r["txn_id"], r["position"]), []).append(r)
    assert parts.keys() == whole.keys() and parts
    values = {r["txn_id"]: r for r in rows.collect()}
    for key, changes in parts.items():
        changes.sort(key=lambda r: r["change"])
        assert len(changes) == whole[key]["n_changes"]
        said = [f"{r['feature']}={r['new_category'] or int(r['new_value'])}" for r in changes]
        assert "; ".join(said) == whole[key]["changes"]
        for r in changes:
            own = values[key[0]][r["feature"]]
            assert r["old_category"] == own if r["feature"] == "merchant_category" else r["old_value"] == float(own)


@pytest.mark.parametrize("depth", [1, 5, 6, 7])
def test_leaf_masks_end_where_the_walk_ends(depth):
    """Scores by masks and from node to node: the same leaves, also on a cut, beyond all cuts, and for missing values."""
    rng = np.random.default_rng(depth)
    points = rng.normal(size=(3000, 5))
    points[:, 0] = rng.integers(0, 24, len(points))
    points[rng.random(points.shape) < 0.05] = np.nan
    points[7], points[8] = -np.inf, np.inf
    label = (np.nan_to_num(np.clip(points, -99, 99)).sum(axis=1) > 5).astype(float)
    model = boosting.fit(points, label, list("abcde"), True, boosting.Settings(n_estimators=20, max_depth=depth))
    walked, steps = model._walked(points, True)
    margins, moves = model.margins(points, True)
    assert (margins == walked).all() and (model.margins(points)[0] == walked).all() and np.allclose(moves, steps, atol=1e-12)
    assert ("_plan" in vars(model)) == (depth <= 6)  # masks have a bit for each of 64 leaves
