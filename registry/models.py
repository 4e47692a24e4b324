"""Scores, explanations, model metrics, training jobs, credit index."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.features import rounded
from registry.sqlbase import RISK, SCORED, TXN, logit, query, rate_of, uniform01
from riskweave import dataset
from riskweave.operators.boosting import Settings, with_margin
from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.plans import anomaly, credit, explain, metrics, models, scoring
from riskweave.plans.explain import SEARCH_GRID
from riskweave.plans.scoring import FIXED_MODEL
from riskweave.schemas import CATEGORIES, FEATURE_DESCRIPTIONS
from riskweave.session import materialize, run_dir


def _attributed(spark, path):
    return scoring.attributions(dataset.scored(spark, path))


def attributions_top5(spark, path):
    top = scoring.top_attributions(_attributed(spark, path))
    return top.select("txn_id", F.posexplode("top_features").alias("position", "f")).select("txn_id", "position", "f.*")


def global_importance(spark, path):
    return rounded(scoring.global_importance(_attributed(spark, path)), "mean_abs_attribution")


def _explanations(spark, path):
    """Every row is explained; flagged rows again an hour later."""
    top = scoring.top_attributions(_attributed(spark, path))
    later = F.when(F.col("decision") != "CLEAR", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = top.withColumn("revision", F.explode(later))
    at = F.col("created_at") + F.expr("make_dt_interval(0, revision)")
    return again.select(
        "txn_id", F.col("top_features")[0]["feature"].alias("top_feature"), "revision", at.alias("created_at")
    )


def _valid_scores(spark, path):
    """Only rows that pass the amount rule were scored into the mart."""
    scored = dataset.scored(spark, path).filter(F.col("amount") >= 1)
    return scoring.risk_scores(scored, F.col("created_at"))


def explanation_lookup(spark, path):
    return explain.latest_explanations(_explanations(spark, path), _valid_scores(spark, path), "left")


def explanation_inner(spark, path):
    return explain.latest_explanations(_explanations(spark, path), _valid_scores(spark, path), "inner")


def binary_metrics(spark, path):
    out = metrics.binary_metrics(dataset.scored(spark, path), "raw_probability", "is_fraud")
    return rounded(out, "roc_auc", "average_precision", "f1")


SCENARIOS = [
    {"name": "burst", "txn_velocity_1h": 15},
    {"name": "foreign", "is_foreign_merchant": 1},
    {"name": "wire", "merchant_category": "wire_transfer"},
    {"name": "small_grocery", "amount": 42.0, "merchant_category": "grocery"},
]


def whatif_delta(spark, path):
    return explain.what_if(dataset.scored(spark, path), SCENARIOS)


def counterfactuals(spark, path):
    return explain.counterfactuals(dataset.scored(spark, path))


def counterfactual_details(spark, path):
    return explain.counterfactual_details(dataset.scored(spark, path))


def _credit_rows(spark, path):
    return dataset.transactions(spark, path).withColumn("account_age_days", F.col("age_days"))


def credit_target(spark, path):
    out = _credit_rows(spark, path).withColumn("credit_risk_target", credit.credit_target())
    return rounded(out.select("txn_id", "credit_risk_target"), "credit_risk_target")


def credit_index(spark, path):
    """Index with the fraud probability and the ratio in the model slots."""
    scored = dataset.scored(spark, path).withColumn("anomaly", F.round(F.least(F.col("amount_vs_avg_ratio") / 20, F.lit(1.0)), 6))
    out = credit.credit_index(scored, "fraud_probability", "anomaly")
    return out.select("txn_id", "model_component", "anomaly_component", "bureau_component", "credit_risk_score", "risk_band")


def regression_metrics(spark, path):
    """The target against the formula without its residual part."""
    rows = _credit_rows(spark, path).select(
        credit.credit_target().alias("truth"), credit.credit_target(F.lit(0.5)).alias("guess")
    )
    return rounded(metrics.regression_metrics(rows, F.col("truth"), F.col("guess")), "mae", "rmse", "r2")


def blended_score(spark, path):
    scored = dataset.scored(spark, path)
    unusual = F.least(F.col("amount_vs_avg_ratio") / 20, F.lit(1.0))
    return scored.select("txn_id", F.round(credit.blended_score(F.col("fraud_probability"), unusual), 6).alias("blended_score"))


def label_codes(spark, path):
    return fit_codes(dataset.base_transactions(spark, path), ["merchant_category", "channel"])


def label_encoded(spark, path):
    """Categories coded on the baseline rows; later ones may be unseen."""
    txns = dataset.base_transactions(spark, path)
    codes = fit_codes(txns.filter(F.col("channel") != "error"), ["channel"])
    return apply_codes(txns, codes, ["channel"], suffix="_code").select("txn_id", "channel", "channel_code")


def _stored(spark, path):
    """Transactions with their features, written once for jobs of many passes."""
    return materialize(dataset.transactions(spark, path), "transactions")


#: what the boosted queries fit with; the search has its own
FRAUD_FIT = Settings(n_estimators=400, max_depth=5, learning_rate=0.05, scale_pos_weight=4.0)
CREDIT_FIT = Settings(n_estimators=300, max_depth=4, learning_rate=0.05)


def _held_out(rows, kind):
    return models.labelled(rows, kind).filter(F.col("split") == "test")


def gbt_scores(spark, path):
    """Train on train + validation, score the held-out rows."""
    rows = _stored(spark, path)
    out = models.fraud_scores(_held_out(rows, "fraud"), models.train(rows, "fraud", FRAUD_FIT))
    return out.select("txn_id", "fraud_probability", "fraud_risk_score", "decision")


def gbt_metrics(spark, path):
    rows = _stored(spark, path)
    scored = models.fraud_scores(_held_out(rows, "fraud"), models.train(rows, "fraud", FRAUD_FIT))
    return rounded(metrics.binary_metrics(scored, "raw_probability", "is_fraud"), "roc_auc", "average_precision", "f1")


def _search(spark, path, kind, rows):
    split = materialize(models.labelled(rows, kind), "search")
    codes = materialize(fit_codes(split.filter(F.col("split") != "test"), ["merchant_category"]), "codes")
    found = models.search(models.prepared(split, kind, codes), kind)
    return [(t["trial"], place, {k: float(v) for k, v in t["settings"].items()}, t["score"]) for place, t in enumerate(found, 1)]


def gbt_search(spark, path):
    """Validation AUC of every trial of the fraud model's search, and its place."""
    trials = _search(spark, path, "fraud", _stored(spark, path))
    return spark.createDataFrame(trials, "trial int, place int, params map<string,double>, auc double")


def credit_search(spark, path):
    """Mean absolute error on validation rows of every trial of the credit model's search, and its place."""
    trials = _search(spark, path, "credit", materialize(_credit_rows(spark, path), "credit"))
    return spark.createDataFrame([(*t[:3], -t[3]) for t in trials], "trial int, place int, params map<string,double>, mae double")


def credit_model_metrics(spark, path):
    rows = materialize(_credit_rows(spark, path), "credit")
    bundle = models.train(rows, "credit", CREDIT_FIT)
    held_out = models.prepared(_held_out(rows, "credit"), "credit", bundle.codes)
    scored = with_margin(held_out, bundle.model, {f: F.col(f).cast("double") for f in bundle.model.features}, "prediction")
    guess = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return rounded(metrics.regression_metrics(scored, F.col("label"), guess), "mae", "rmse", "r2")


def _reloaded(spark, bundle):
    path = run_dir(spark, f"bundle-{bundle.kind}")
    models.save(bundle, path)
    return models.load(spark, path)


def model_roundtrip_scores(spark, path):
    """Every row scored by trained models, and by the same models saved and loaded."""
    rows = _stored(spark, path)
    fraud, forest = models.train(rows, "fraud", FRAUD_FIT), models.train_forest(rows)
    names = ["raw_probability", "decision", "anomaly_raw", "is_anomaly"]
    before = models.anomaly_scores(models.fraud_scores(rows, fraud), forest)
    before = before.select("*", F.struct(*names).alias("before")).drop(*names)
    after = models.anomaly_scores(models.fraud_scores(before, _reloaded(spark, fraud)), _reloaded(spark, forest))
    return after.select("txn_id", *[F.col(f"before.{c}").eqNullSafe(F.col(c)).alias(f"same_{c}") for c in names])


def credit_end_to_end(spark, path):
    """The composed credit score of every row, checked against its stored components, the bands and the features that it reports."""
    rows = materialize(_credit_rows(spark, path), "credit")
    bundles = [_reloaded(spark, b) for b in (models.train(rows, "credit", CREDIT_FIT), models.train_forest(rows))]
    scored = materialize(models.credit_scores(rows, *bundles), "credit-scores")
    score = F.col("credit_risk_score")
    again = F.lit(50.0) * F.col("model_component") + F.lit(35.0) * F.col("anomaly_component") + F.lit(15.0) * F.col("bureau_component")
    named = F.element_at(F.array(*[F.lit(b) for b in ("VERY_LOW", "LOW", "MEDIUM", "HIGH")]), F.greatest(F.ceil(score / 25).cast("int"), F.lit(1)))
    whole = F.floor(F.greatest(score - 1, F.lit(0.0)) / 25) == F.floor(F.greatest(F.ceil(score) - 1, F.lit(0)) / 25)
    size = F.transform("top_features", lambda f: F.abs(f["shap_value"]))
    return scored.select(
        "txn_id",
        "bureau_component",
        (score.between(0, 100) & (F.abs(score - again) < 0.011)).alias("composite_follows"),
        F.when((F.col("risk_band") == "UNKNOWN"), ~whole | (score != F.floor(score))).otherwise(F.col("risk_band") == named).alias("band_follows"),
        F.size("top_features").alias("n_features"),
        (size == F.sort_array(size, asc=False)).alias("features_ranked"),
    )


def isolation_forest_scores(spark, path):
    txns = _stored(spark, path)
    out = anomaly.score(txns, anomaly.train(txns))
    return out.select("txn_id", F.round("anomaly_raw", 6).alias("anomaly_raw"), "anomaly_score", "is_anomaly", "anomaly_contribution")


def anomaly_summary(spark, path):
    txns = _stored(spark, path)
    return rounded(anomaly.training_summary(anomaly.score(txns, anomaly.train(txns))), "anomaly_rate", "mean_score", "std_score")


QUERIES = {
    "attributions_top5": attributions_top5,
    "global_importance": global_importance,
    "explanation_lookup": explanation_lookup,
    "explanation_inner": explanation_inner,
    "binary_metrics": binary_metrics,
    "whatif_delta": whatif_delta,
    "counterfactuals": counterfactuals,
    "counterfactual_details": counterfactual_details,
    "credit_target": credit_target,
    "credit_index": credit_index,
    "regression_metrics": regression_metrics,
    "blended_score": blended_score,
    "label_codes": label_codes,
    "label_encoded": label_encoded,
    "gbt_scores": gbt_scores,
    "gbt_metrics": gbt_metrics,
    "gbt_search": gbt_search,
    "credit_search": credit_search,
    "credit_model_metrics": credit_model_metrics,
    "model_roundtrip_scores": model_roundtrip_scores,
    "credit_end_to_end": credit_end_to_end,
    "isolation_forest_scores": isolation_forest_scores,
    "anomaly_summary": anomaly_summary,
}

_INPUTS = {
    "amount": "amount",
    "hour_of_day": "CAST(hour_of_day AS DOUBLE)",
    "day_of_week": "CAST(day_of_week AS DOUBLE)",
    "txn_velocity_1h": "CAST(txn_velocity_1h AS DOUBLE)",
    "amount_vs_avg_ratio": "amount_vs_avg_ratio",
    "is_foreign_merchant": "CAST(CAST(is_foreign_merchant AS INTEGER) AS DOUBLE)",
    "merchant_category_encoded": rate_of("merchant_category"),
}
_ATTRIBUTED = (
    SCORED
    + ", means AS (SELECT "
    + ", ".join(f"avg({x}) AS m_{n}" for n, x in _INPUTS.items())
    + " FROM scored), attributed AS ("
    + " UNION ALL ".join(
        f"SELECT txn_id, decision, created_at, {i} AS pos, '{n}' AS feature, {float(FIXED_MODEL.weights[n])}e0 * ({x} - m_{n}) AS v FROM scored, means"
        for i, (n, x) in enumerate(_INPUTS.items())
    )
    + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(v) DESC, pos) AS rn FROM attributed)"
)
_TEXT = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for f, t in FEATURE_DESCRIPTIONS.items()) + " END"
_EXPLAINED = (
    _ATTRIBUTED
    + """, explained AS (
  SELECT txn_id, feature AS top_feature, CASE WHEN decision <> 'CLEAR' THEN 1 ELSE 0 END AS revision,
         created_at + to_hours(CASE WHEN decision <> 'CLEAR' THEN 1 ELSE 0 END) AS created_at
  FROM ranked WHERE rn = 1),
mart AS (SELECT txn_id, fraud_probability, fraud_risk_score AS composite_risk_score, decision, created_at AS scored_at FROM scored WHERE amount >= 1)"""
)
_CREDIT = (
    "0.30e0 * (least(greatest(amount_vs_avg_ratio, 0e0), 20e0) / 20e0)"
    " + 0.25e0 * (least(greatest(CAST(txn_velocity_1h AS DOUBLE), 0e0), 15e0) / 15e0)"
    " + 0.20e0 * CAST(CAST(is_foreign_merchant AS INTEGER) AS DOUBLE)"
    " + 0.15e0 * (1e0 - least(greatest(CAST(age_days AS DOUBLE), 0e0), 3650e0) / 3650e0) + 0.10e0 * {}"
)
_TRUTH, _GUESS = _CREDIT.format(uniform01("txn_id", "credit-residual")), _CREDIT.format("0.5e0")


def _scenario_sql():
    parts = []
    for s in SCENARIOS:
        z = logit(
            amount=f"{float(s['amount'])}e0" if "amount" in s else "amount",
            velocity=f"{float(s['txn_velocity_1h'])}e0" if "txn_velocity_1h" in s else "txn_velocity_1h",
            foreign="1e0" if "is_foreign_merchant" in s else None,
            category=f"'{s['merchant_category']}'" if "merchant_category" in s else "merchant_category",
        )
        parts.append(f"SELECT txn_id, '{s['name']}' AS scenario, p AS p0, 1e0 / (1e0 + exp(-({z}))) AS p1 FROM scored")
    return " UNION ALL ".join(parts)


def _counterfactual_sql():
    """Brute force: every flagged row against every combination of options."""
    w = FIXED_MODEL.weights
    shares = [s for s in SEARCH_GRID["amount_share"] if s != 1.0]
    keep = "(0, NULL, NULL)"
    amount_rows = ", ".join([keep] + [f"({i + 1}, {s}e0, {1.0 - s!r}e0)" for i, s in enumerate(shares)])
    velocity_rows = ", ".join([keep] + [f"({i + 1}, {float(v)}e0, NULL)" for i, v in enumerate(SEARCH_GRID["txn_velocity_1h"])])
    foreign_rows = ", ".join([keep] + [f"({i + 1}, {float(v)}e0, NULL)" for i, v in enumerate(SEARCH_GRID["is_foreign_merchant"])])
    category_rows = ", ".join(["(0, NULL)"] + [f"({i + 1}, '{c}')" for i, c in enumerate(CATEGORIES)])
    return f"""{SCORED},
flagged AS (SELECT *, CAST(CAST(is_foreign_merchant AS INTEGER) AS DOUBLE) AS f, {rate_of("merchant_category")} AS r FROM scored WHERE p > 0.5),
ga(a_pos, a_val, a_dist) AS (VALUES {amount_rows}), gv(v_pos, v_val, v_x) AS (VALUES {velocity_rows}),
gf(f_pos, f_val, f_x) AS (VALUES {foreign_rows}), gc(c_pos, c_val) AS (VALUES {category_rows}),
options AS (
  SELECT txn_id, p, z, a_pos, v_pos, f_pos, c_pos, c_val, v_val, f_val, floor(amount * a_val) AS a_new,
    CASE WHEN a_pos > 0 THEN floor(amount * a_val) - amount ELSE 0e0 END AS da, coalesce(a_dist, 0e0) AS a_dist,
    CASE WHEN v_pos > 0 THEN v_val - txn_velocity_1h ELSE 0e0 END AS dv,
    CASE WHEN f_pos > 0 THEN f_val - f ELSE 0e0 END AS df,
    CASE WHEN c_pos > 0 THEN {rate_of("c_val")} - r ELSE 0e0 END AS dc
  FROM flagged, ga, gv, gf, gc
  WHERE (a_pos = 0 OR abs(floor(amount * a_val) - amount) > 0.01) AND (v_pos = 0 OR abs(v_val - txn_velocity_1h) > 0.01)
    AND (f_pos = 0 OR abs(f_val - f) > 0.01) AND (c_pos = 0 OR c_val <> merchant_category)),
candidates AS (
  SELECT *, CAST(a_pos > 0 AS INTEGER) + CAST(v_pos > 0 AS INTEGER) + CAST(f_pos > 0 AS INTEGER) + CAST(c_pos > 0 AS INTEGER) AS n_changes,
    round(a_dist + CASE WHEN v_pos > 0 THEN abs(dv) / 15e0 ELSE 0 END + CASE WHEN f_pos > 0 THEN 1e0 ELSE 0 END + CASE WHEN c_pos > 0 THEN 1e0 ELSE 0 END, 6) AS distance,
    0e0 + {w["amount"]}e0 * da + {w["txn_velocity_1h"]}e0 * dv + {w["is_foreign_merchant"]}e0 * df + {w["merchant_category_encoded"]}e0 * dc AS effect,
    concat_ws('; ', CASE WHEN a_pos > 0 THEN 'amount=' || CAST(CAST(a_new AS BIGINT) AS VARCHAR) END,
      CASE WHEN v_pos > 0 THEN 'txn_velocity_1h=' || CAST(CAST(v_val AS BIGINT) AS VARCHAR) END,
      CASE WHEN f_pos > 0 THEN 'is_foreign_merchant=' || CAST(CAST(f_val AS BIGINT) AS VARCHAR) END,
      CASE WHEN c_pos > 0 THEN 'merchant_category=' || c_val END) AS changes
  FROM options),
best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY txn_id ORDER BY n_changes, distance, a_pos, v_pos, f_pos, c_pos) AS INTEGER) AS position
  FROM candidates WHERE n_changes > 0 AND z + effect < 0 QUALIFY position <= 3)
SELECT txn_id, position, round(p * 100, 2) AS original_risk_score, round(1e0 / (1e0 + exp(-(z + effect))) * 100, 2) AS target_risk_score,
  n_changes, changes, CASE WHEN n_changes <= 2 THEN 'actionable' ELSE 'requires_multiple_changes' END AS feasibility, false AS is_fallback
FROM best
UNION ALL
SELECT txn_id, 1, round(p * 100, 2), 35e0, 1, 'merchant_category=grocery', 'actionable', true
FROM flagged ANTI JOIN best USING (txn_id)"""


def _code_sql(column):
    return f"""SELECT '{column}' AS "column", {column} AS value, CAST(row_number() OVER (ORDER BY {column}) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT {column} FROM scored)"""


SQL = {
    "attributions_top5": query(
        _ATTRIBUTED,
        f"""SELECT txn_id, CAST(rn - 1 AS INTEGER) AS position, feature, round(v, 4) AS shap_value, {_TEXT} AS description,
        CASE WHEN v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM ranked WHERE rn <= 5""",
    ),
    "global_importance": query(
        _ATTRIBUTED, "SELECT feature, round(avg(abs(v)), 6) AS mean_abs_attribution FROM attributed GROUP BY feature"
    ),
    "explanation_lookup": query(_EXPLAINED, "SELECT * FROM explained LEFT JOIN mart USING (txn_id)"),
    "explanation_inner": query(_EXPLAINED, "SELECT * FROM explained JOIN mart USING (txn_id)"),
    "binary_metrics": query(
        SCORED,
        """, steps AS (SELECT p AS s, sum(CAST(is_fraud AS INTEGER)) AS pos, sum(1 - CAST(is_fraud AS INTEGER)) AS neg FROM scored GROUP BY p),
        curve AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM steps WINDOW w AS (ORDER BY s DESC)),
        t AS (SELECT sum(pos) AS p, sum(neg) AS n, sum(neg * (cp - pos / 2e0)) AS pairs, sum(pos * (cp / CAST(cp + cn AS DOUBLE))) AS ap,
          sum(CASE WHEN s > 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s > 0.5 THEN neg ELSE 0 END) AS fp FROM curve)
        SELECT CAST(p + n AS BIGINT) AS n_rows, CAST(p AS BIGINT) AS n_positive, round(pairs / (CAST(p AS DOUBLE) * n), 6) AS roc_auc,
        round(ap / CAST(p AS DOUBLE), 6) AS average_precision, round(CAST(2 * tp AS DOUBLE) / (tp + fp + p), 6) AS f1 FROM t""",
    ),
    "whatif_delta": query(
        SCORED,
        f"""SELECT txn_id, scenario, round(p0 * 100, 2) AS original_score, round(p1 * 100, 2) AS scenario_score,
        round((p1 - p0) * 100, 4) AS score_delta FROM ({_scenario_sql()})""",
    ),
    "counterfactuals": f"WITH {_counterfactual_sql()}",
    "counterfactual_details": f"""WITH {_counterfactual_sql().replace("SELECT txn_id, position, round(p * 100, 2)", ", found AS (SELECT txn_id, position, round(p * 100, 2)", 1)}),
        parts AS (SELECT *, unnest(string_split(changes, '; ')) AS part, CAST(unnest(range(1, len(string_split(changes, '; ')) + 1)) AS INTEGER) AS change FROM found),
        named AS (SELECT *, split_part(part, '=', 1) AS feature, split_part(part, '=', 2) AS v FROM parts)
        SELECT txn_id, CAST(position AS INTEGER) AS position, change, feature,
          CASE feature WHEN 'amount' THEN s.amount WHEN 'txn_velocity_1h' THEN CAST(s.txn_velocity_1h AS DOUBLE)
                       WHEN 'is_foreign_merchant' THEN CAST(CAST(s.is_foreign_merchant AS INTEGER) AS DOUBLE) END AS old_value,
          CASE WHEN feature <> 'merchant_category' THEN CAST(v AS DOUBLE) END AS new_value,
          CASE WHEN feature = 'merchant_category' THEN s.merchant_category END AS old_category,
          CASE WHEN feature = 'merchant_category' THEN v END AS new_category, original_risk_score, target_risk_score, feasibility
        FROM named JOIN scored s USING (txn_id)""",
    "credit_target": query(TXN, f"SELECT txn_id, round(least(greatest({_TRUTH}, 0e0), 1e0), 6) AS credit_risk_target FROM txn"),
    "credit_index": query(
        SCORED,
        f"""SELECT txn_id, model_component, anomaly_component, bureau_component, credit_risk_score,
        CASE WHEN credit_risk_score BETWEEN 0 AND 25 THEN 'VERY_LOW' WHEN credit_risk_score BETWEEN 26 AND 50 THEN 'LOW'
             WHEN credit_risk_score BETWEEN 51 AND 75 THEN 'MEDIUM' WHEN credit_risk_score BETWEEN 76 AND 100 THEN 'HIGH' ELSE 'UNKNOWN' END AS risk_band
        FROM (SELECT txn_id, round(fraud_probability, 4) AS model_component, a AS anomaly_component, round(b, 4) AS bureau_component,
                round((0.50e0 * fraud_probability + 0.35e0 * a + 0.15e0 * b) * 100, 2) AS credit_risk_score
              FROM (SELECT *, round(least(amount_vs_avg_ratio / 20e0, 1e0), 6) AS a, 0.3e0 * {uniform01("account_id", "bureau")} AS b FROM scored))""",
    ),
    "regression_metrics": query(
        TXN,
        f"""SELECT round(avg(abs(t - g)), 6) AS mae, round(sqrt(avg((t - g) * (t - g))), 6) AS rmse,
        round(1e0 - avg((t - g) * (t - g)) / var_pop(t), 6) AS r2 FROM (SELECT {_TRUTH} AS t, {_GUESS} AS g FROM txn)""",
    ),
    "blended_score": query(
        SCORED,
        "SELECT txn_id, round((0.65e0 * fraud_probability + 0.35e0 * least(amount_vs_avg_ratio / 20e0, 1e0)) * 100, 6) AS blended_score FROM scored",
    ),
    "model_roundtrip_scores": query(
        TXN, "SELECT txn_id, true AS same_raw_probability, true AS same_decision, true AS same_anomaly_raw, true AS same_is_anomaly FROM txn"
    ),
    "credit_end_to_end": query(
        TXN,
        f"""SELECT txn_id, round(0.3e0 * {uniform01("account_id", "bureau")}, 4) AS bureau_component, true AS composite_follows, true AS band_follows,
        CAST(5 AS INTEGER) AS n_features, true AS features_ranked FROM txn""",
    ),
    "label_codes": query(SCORED, f"{_code_sql('merchant_category')} UNION ALL {_code_sql('channel')}"),
    "label_encoded": query(
        SCORED,
        """SELECT txn_id, channel, CAST(CASE channel WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS INTEGER) AS channel_code FROM scored""",
    ),
}
