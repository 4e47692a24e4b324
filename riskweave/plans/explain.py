"""Explanation look-ups, what-if scenarios and counterfactual search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import base_rate
from riskweave.operators.keyed import latest_per_key
from riskweave.plans.scoring import FIXED_MODEL, LinearModel, logit, model_inputs, sigmoid
from riskweave.schemas import CATEGORIES, CATEGORY_BASE_RATES, CLASS_CUTOFF


def explanation_rows(attributed: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the explanation audit."""
    return attributed.select("txn_id", F.to_json("top_features").alias("top_features"), created_at.alias("created_at"))


def latest_explanations(explanations: DataFrame, scores: DataFrame, how: str = "left") -> DataFrame:
    """Newest explanation of every transaction with its risk score."""
    newest = latest_per_key(explanations, ["txn_id"], ["created_at"])
    kept = scores.select("txn_id", "fraud_probability", "composite_risk_score", "decision", "scored_at")
    return newest.join(kept, "txn_id", how)


def what_if(scored: DataFrame, scenarios: list[dict], model: LinearModel = FIXED_MODEL) -> DataFrame:
    """Score every row under every scenario and report the change.

    A scenario is a dict with ``name`` and feature overrides. The list is part
    of the request, so it travels inside the plan and unrolls per row.
    """
    inputs = model_inputs()
    probabilities = []
    for scenario in scenarios:
        changed = {f: v for f, v in scenario.items() if f != "name"}
        unknown = changed.keys() - inputs.keys() - {"merchant_category"}
        if unknown:
            raise ValueError(f"scenario {scenario['name']} overrides unknown features: {sorted(unknown)}")
        moved = dict(inputs)
        for feature, value in changed.items():
            if feature == "merchant_category":
                moved["merchant_category_encoded"] = base_rate(F.lit(value))
            else:
                moved[feature] = F.lit(float(value))
        probabilities.append(
            F.struct(F.lit(scenario["name"]).alias("scenario"), sigmoid(logit(model, moved)).alias("p"))
        )
    return scored.select("txn_id", "raw_probability", F.inline(F.array(*probabilities))).select(
        "txn_id",
        "scenario",
        F.round(F.col("raw_probability") * 100, 2).alias("original_score"),
        F.round(F.col("p") * 100, 2).alias("scenario_score"),
        F.round((F.col("p") - F.col("raw_probability")) * 100, 4).alias("score_delta"),
    )


# what the search may change, as values to try in this order; amounts are
# shares of the original amount, cut to whole units
SEARCH_GRID = {
    "amount_share": [1.0, 0.75, 0.5, 0.25, 0.1],
    "txn_velocity_1h": [0, 1],
    "is_foreign_merchant": [0],
    "merchant_category": CATEGORIES,
}


def _doubles(values: list) -> str:
    return f"array({', '.join(f'{float(v)}D' for v in values)})"


def _axis(values: str, delta: str, weight: float, distance: str, label: str, applies: str | None = None) -> str:
    """Options of one feature as SQL: keep it (first), or take a value ``v``.

    Values that would not change the feature are left out.
    """
    keep = "struct(0 AS place, 0 AS changed, 0D AS effect, 0D AS distance, string(null) AS label, true AS applies)"
    return f"""filter(concat(array({keep}), transform({values}, (v, i) -> struct(
        i + 1 AS place, 1 AS changed, {weight}D * ({delta}) AS effect, {distance} AS distance, {label} AS label,
        {applies or f"abs({delta}) > 0.01D"} AS applies))), o -> o.applies)"""


def counterfactuals(
    scored: DataFrame, model: LinearModel = FIXED_MODEL, grid: dict | None = None, k: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Smallest changes that turn a flagged row (class 1) into class 0.

    Each feature may keep its value or take one of its grid values. The grid is
    a constant, so the search is an array expression inside the row: candidates
    are built, scored, filtered and ranked without a join or a shuffle. Ranked
    by number of changes, then distance, then grid order; candidates with more
    changes are only built for rows that fewer changes leave short of ``k``. A
    row with no solution gets the fixed fallback. ``keep``: columns to carry along.
    """
    grid = grid or SEARCH_GRID
    c, w = F.col, model.weights
    shares = [v for v in grid["amount_share"] if v != 1.0]
    rates = [f"struct('{v}' AS name, {CATEGORY_BASE_RATES[v]}D AS rate)" for v in grid["merchant_category"]]
    axes = {
        "_amounts": _axis(
            _doubles(shares),
            delta="floor(amount * v) - amount",
            weight=w["amount"],
            distance="1D - v",
            label="concat('amount=', floor(amount * v))",
        ),
        "_velocities": _axis(
            _doubles(grid["txn_velocity_1h"]),
            delta="v - txn_velocity_1h",
            weight=w["txn_velocity_1h"],
            distance="abs(v - txn_velocity_1h) / 15D",
            label="concat('txn_velocity_1h=', int(v))",
        ),
        "_foreigns": _axis(
            _doubles(grid["is_foreign_merchant"]),
            delta="v - int(is_foreign_merchant)",
            weight=w["is_foreign_merchant"],
            distance="1D",
            label="concat('is_foreign_merchant=', int(v))",
        ),
        "_categories": _axis(
            f"array({', '.join(rates)})",
            delta="v.rate - _rate",
            weight=w["merchant_category_encoded"],
            distance="1D",
            label="concat('merchant_category=', v.name)",
            applies="v.name <> merchant_category",
        ),
    }

    def solve(most: int) -> Column:
        candidates = "array(struct(0 AS n, 0D AS distance, array() AS places, 0D AS effect, array() AS labels))"
        for axis in axes:
            candidates = f"""flatten(transform({candidates}, a -> transform(
                CASE WHEN a.n < {most} THEN {axis} ELSE slice({axis}, 1, 1) END, o -> struct(
                    a.n + o.changed AS n, a.distance + o.distance AS distance, concat(a.places, array(o.place)) AS places,
                    a.effect + o.effect AS effect, concat(a.labels, array(o.label)) AS labels))))"""
        # the class changes when the log-odds fall below 0, i.e. probability < 0.5
        return F.expr(
            f"""slice(array_sort(transform(filter({candidates}, a -> a.n > 0 AND _z + a.effect < 0), a -> struct(
                a.n AS n_changes, round(a.distance, 6) AS distance, a.places AS places, a.effect AS effect,
                array_join(a.labels, '; ') AS changes))), 1, {int(k)})"""
        )

    flagged = scored.filter(c("raw_probability") > CLASS_CUTOFF)
    found = flagged.withColumns({"_z": logit(model, model_inputs()), "_rate": base_rate(c("merchant_category"))})
    found = found.withColumns({name: F.expr(axis) for name, axis in axes.items()})
    found = found.withColumn("_best", solve(1))
    for most in range(2, len(axes) + 1):
        found = found.withColumn("_best", F.when(F.size("_best") >= k, c("_best")).otherwise(solve(most)))
    fallback = F.struct(
        F.lit(1).alias("n_changes"),
        F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("array<int>").alias("places"),
        F.lit(None).cast("double").alias("effect"),
        F.lit("merchant_category=grocery").alias("changes"),
    )
    best = F.when(F.size("_best") > 0, c("_best")).otherwise(F.array(fallback))
    target = F.when(c("b.effect").isNotNull(), F.round(sigmoid(c("_z") + c("b.effect")) * 100, 2)).otherwise(35.0)
    return found.select("txn_id", *keep, "raw_probability", "_z", F.posexplode(best).alias("pos", "b")).select(
        "txn_id",
        *keep,
        (c("pos") + 1).alias("position"),
        F.round(c("raw_probability") * 100, 2).alias("original_risk_score"),
        target.alias("target_risk_score"),
        c("b.n_changes").alias("n_changes"),
        c("b.changes").alias("changes"),
        F.when(c("b.n_changes") <= 2, "actionable").otherwise("requires_multiple_changes").alias("feasibility"),
        c("b.effect").isNull().alias("is_fallback"),
    )


def counterfactual_details(scored: DataFrame, model: LinearModel = FIXED_MODEL, grid: dict | None = None, k: int = 3) -> DataFrame:
    """A row per change of every counterfactual: what the feature is, what it would have to be, and the score that this leads to.

    A category stands in ``old_category`` and ``new_category``, any other feature in ``old_value`` and ``new_value``.
    """
    names = ("amount", "txn_velocity_1h", "is_foreign_merchant", "merchant_category")
    found = counterfactuals(scored, model, grid, k, keep=names)
    each = found.select("*", F.posexplode(F.split("changes", "; ")).alias("_at", "_change")).select(
        "*", F.substring_index("_change", "=", 1).alias("feature"), F.substring_index("_change", "=", -1).alias("_new")
    )
    category = F.col("feature") == "merchant_category"
    old = F.lit(None).cast("double")
    for name in names[:3]:
        number = F.col(name).cast("int") if name == "is_foreign_merchant" else F.col(name)
        old = F.when(F.col("feature") == name, number.cast("double")).otherwise(old)
    return each.select(
        "txn_id", "position", (F.col("_at") + 1).alias("change"), "feature",
        old.alias("old_value"), F.when(~category, F.col("_new").cast("double")).alias("new_value"),
        F.when(category, F.col("merchant_category")).alias("old_category"), F.when(category, F.col("_new")).alias("new_category"),
        "original_risk_score", "target_risk_score", "feasibility",
    )
