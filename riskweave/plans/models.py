"""Trained models: fit, search, save as one folder, load back, score, explain.

A bundle is a folder with everything that a score depends on, so that a scorer rebuilt from it gives the same scores:

    model/   trees of a boosted model, or nodes of a forest, as a table
    codes/   label codes of the category (fraud and credit models)
    about/   one line of JSON: kind, version, ordered features, defaults, cut-offs, means, scales, offset, settings, metrics

``about`` is written last; a folder without it is no bundle. Tables of any size are scored, fits see a bounded sample (``SAMPLE`` rows) of the
split that asks for it.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import uniform01
from riskweave.operators import boosting
from riskweave.operators.boosting import Ensemble, Settings
from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.operators.forest import Forest
from riskweave.plans import anomaly, credit, scoring, staging, wide
from riskweave.plans.training import CATEGORY
from riskweave.schemas import (
    ANOMALY_DEFAULTS,
    ANOMALY_FEATURES,
    CLASS_CUTOFF,
    CREDIT_DEFAULTS,
    CREDIT_DESCRIPTIONS,
    CREDIT_FEATURES,
    FRAUD_CUTOFF,
    FRAUD_DEFAULTS,
    FRAUD_FEATURES,
    MODEL_VERSION,
    REVIEW_CUTOFF,
    SEARCH_SPACES,
    SEARCH_TRIALS,
    SENTINEL,
    WIDE_FEATURES,
)
from riskweave.session import materialize
from riskweave.sources.files import parquet_if_exists

#: rows that a fit, and a trial of a search, may see
SAMPLE = 20_000
FORMAT = 1

_KINDS = {"fraud": (FRAUD_FEATURES, FRAUD_DEFAULTS), "credit": (CREDIT_FEATURES, CREDIT_DEFAULTS)}
_CUTOFFS = {"fraud": FRAUD_CUTOFF, "review": REVIEW_CUTOFF, "class": CLASS_CUTOFF}
_FOREST = "part string, position int, value array<double>"


@dataclass
class Bundle:
    """A trained model with what its scores depend on. ``codes`` is null for a forest."""

    kind: str
    model: Ensemble | Forest
    codes: DataFrame | None
    about: dict

    @property
    def version(self) -> str:
        return self.about["version"]


# --- inputs -----------------------------------------------------------------------------------------------------------


def prepared(df: DataFrame, kind: str, codes: DataFrame) -> DataFrame:
    """Missing features filled and the category coded; an unseen one is 0."""
    return apply_codes(scoring.fill_defaults(df, _KINDS[kind][1]), codes, [CATEGORY], suffix="_encoded")


def _inputs(kind: str) -> dict[str, Column]:
    flag = {"is_foreign_merchant": F.col("is_foreign_merchant").cast("int")}
    return {f: flag.get(f, F.col(f)) for f in _KINDS[kind][0]}


def _numbers(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns({f: c.cast("double") for f, c in _inputs(kind).items()})


def labelled(df: DataFrame, kind: str) -> DataFrame:
    """The label of a kind, and the split: 15 % test, of the rest 15 % validation."""
    if kind == "fraud":
        label, draw = F.col("is_fraud").cast("double"), F.concat_ws("|", F.col("is_fraud").cast("string"), "txn_id")
    else:
        label, draw = credit.credit_target(), F.col("txn_id")
    return staging.split_by_hash(df.withColumn("label", label), uniform01(draw, "split"))


# --- training ---------------------------------------------------------------------------------------------------------


def draw_trials(kind: str, trials: int, seed: int = 42) -> list[Settings]:
    """Random points of the kind's search space: whole numbers, or uniform, or uniform in the logarithm."""
    rng = random.Random(seed)
    out = []
    for number in range(trials):
        point = {}
        for name, (low, high, scale) in SEARCH_SPACES[kind].items():
            if scale == "whole":
                point[name] = rng.randint(low, high)
            elif scale == "log":
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.uniform(low, high)
        out.append(Settings(**point, seed=seed + number))
    return out


def search(rows: DataFrame, kind: str, trials: int | None = None, sample: int = SAMPLE, key: str = "txn_id", space: list[Settings] | None = None) -> list[dict]:
    """Trials of a random search, best first: fitted on the training split, judged on the validation split of ``rows``.

    ``rows``: labelled, split and prepared, and stored, since both splits are sampled from it.
    """
    space = draw_trials(kind, SEARCH_TRIALS[kind] if trials is None else trials) if space is None else space
    numbers, features = _numbers(rows, kind), _KINDS[kind][0]
    known = boosting.sample_rows(numbers.where("split = 'train'"), key, features, "label", sample)
    other = boosting.sample_rows(numbers.where("split = 'validation'"), key, features, "label", sample)
    if not len(known) or not len(other):
        raise ValueError("a search needs training and validation rows")
    return boosting.search(known, other, rows.sparkSession, features, kind == "fraud", space)


def train(df: DataFrame, kind: str, settings: Settings | None = None, trials: int = 0, sample: int = SAMPLE, version: str = MODEL_VERSION, key: str = "txn_id") -> Bundle:
    """Fit a boosted model on the training and validation rows of ``df``; with ``trials``, with the best settings of a search.

    ``df``: transactions with their features, label columns and, for credit, account columns.
    """
    features, defaults = _KINDS[kind]
    split = materialize(labelled(df, kind), f"train-{kind}")
    codes = materialize(fit_codes(scoring.fill_defaults(split.where("split <> 'test'"), defaults), [CATEGORY]), "codes")
    rows = prepared(split, kind, codes)
    found = search(rows, kind, trials, sample, key) if trials else []
    settings = Settings(**found[0]["settings"]) if found else settings or Settings()
    model = boosting.fit_on(_numbers(rows.where("split <> 'test'"), kind), key, features, "label", kind == "fraud", settings, sample)
    about = {
        "kind": kind, "version": version, "features": features, "defaults": defaults, "cutoffs": _CUTOFFS, "category": CATEGORY, "unseen": 0,
        "settings": model.settings, "sample": sample, "trials": [{"trial": t["trial"], "score": t["score"]} for t in found],
    }
    return Bundle(kind, model, codes, about)


def train_forest(df: DataFrame, version: str = MODEL_VERSION, key: str = "txn_id", **params) -> Bundle:
    """Fit the anomaly model on the normal rows of ``df``."""
    model = anomaly.train(df, key, **params)
    return Bundle("anomaly", model, None, {"kind": "anomaly", "version": version, "defaults": ANOMALY_DEFAULTS, **_forest_about(model)})


def _forest_about(model: Forest) -> dict:
    return {
        "features": model.features, "means": model.means, "scales": model.scales, "sample": int(model.sample), "depth": model.depth, "offset": model.offset,
    }


def wide_rows(packed: DataFrame, features: list[str]) -> DataFrame:
    """The packed table with ``features`` as numbers; what a row or the table lacks is the sentinel."""
    blob = [f for f in features if f not in packed.columns]
    opened = wide.unpack(packed, blob) if blob else packed
    return opened.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(SENTINEL))) for f in features})


def train_wide(packed: DataFrame, settings: Settings | None = None, trials: int = 0, sample: int = SAMPLE, version: str = MODEL_VERSION, key: str = "TransactionID") -> Bundle:
    """Fit a fraud model on the packed wide table: the columns of its own that it has, and all that its blobs hold."""
    features = [*[f for f in WIDE_FEATURES if f in packed.columns], *wide.packed_keys(packed)]
    rows = wide_rows(packed, features).select(key, "isFraud", *features).withColumn("label", F.col("isFraud").cast("double"))
    draw = uniform01(F.concat_ws("|", F.col("isFraud").cast("string"), F.col(key).cast("string")), "split")
    split = materialize(staging.split_by_hash(rows, draw), "train-wide")
    found = []
    if trials:
        known, other = (boosting.sample_rows(split.where(f"split = '{part}'"), key, features, "label", sample) for part in ("train", "validation"))
        found = boosting.search(known, other, split.sparkSession, features, True, draw_trials("wide", trials))
    settings = Settings(**found[0]["settings"]) if found else settings or Settings()
    model = boosting.fit_on(split.where("split <> 'test'"), key, features, "label", True, settings, sample)
    about = {
        "kind": "wide", "version": version, "features": features, "defaults": {f: SENTINEL for f in features}, "cutoffs": _CUTOFFS,
        "settings": model.settings, "sample": sample, "trials": [{"trial": t["trial"], "score": t["score"]} for t in found],
    }
    return Bundle("wide", model, None, about)


# --- bundles ----------------------------------------------------------------------------------------------------------


def save(bundle: Bundle, path: str) -> None:
    """Write a bundle to a new folder; an existing one is never written over."""
    spark = SparkSession.active()
    path = path.rstrip("/")
    if bundle.kind == "anomaly":
        rows = [(name, i, row.astype(float).tolist()) for name, array in bundle.model.nodes.items() for i, row in enumerate(array)]
        parts = spark.createDataFrame(rows, _FOREST)
    else:
        parts = boosting.parts_table(spark, bundle.model)
        if bundle.codes is not None:
            bundle.codes.write.mode("error").parquet(f"{path}/codes")
    parts.coalesce(1).write.mode("error").parquet(f"{path}/model")
    text = json.dumps({"format": FORMAT, **bundle.about})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Bundle:
    """Read a bundle back; refuses a folder that is incomplete, of another format, or fitted for other features."""
    path = path.rstrip("/")
    parts = parquet_if_exists(spark, f"{path}/model")
    if parts is None:
        raise LookupError(f"no model bundle at {path}")
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about.pop("format") != FORMAT:
        raise ValueError(f"the bundle at {path} is of another format")
    kind = about["kind"]
    # a wide model has the features that its table had
    expected = {"anomaly": ANOMALY_FEATURES, "wide": about["features"]}.get(kind) or _KINDS[kind][0]
    if about["features"] != expected:
        raise ValueError(f"the bundle at {path} was fitted for other features: {about['features']}")
    if kind == "anomaly":
        rows = parts.toPandas()  # bounded: trees * (2 * sample - 1) nodes
        nodes = {}
        for name, group in rows.groupby("part"):
            whole = name in ("feature", "left", "right")
            nodes[name] = np.stack([np.asarray(x) for x in group.sort_values("position")["value"]]).astype(int if whole else float)
        model = Forest(about["features"], about["means"], about["scales"], about["sample"], nodes, about["depth"], about["offset"])
        return Bundle(kind, model, None, about)
    if about["cutoffs"] != _CUTOFFS:
        raise ValueError(f"the bundle at {path} was fitted for other cut-offs: {about['cutoffs']}")
    model = boosting.from_parts(parts, about["features"], kind != "credit", about["settings"])
    return Bundle(kind, model, None if kind == "wide" else spark.read.parquet(f"{path}/codes"), about)


# --- scoring ----------------------------------------------------------------------------------------------------------


def _attributions(features: list[str], moves: Column) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("feature"), moves[i].alias("value")) for i, f in enumerate(features)])


def _beside(df: DataFrame, added: list[str], score) -> DataFrame:
    """The rows of ``df`` as they are, with the columns that ``score`` adds; defaults and codes stay inside it."""
    kept, name = df.drop(*added), "_row"
    while name in kept.columns:
        name += "_"
    return score(kept.select("*", F.struct("*").alias(name))).select(f"{name}.*", *added)


def fraud_scores(df: DataFrame, bundle: Bundle, explain: bool = False) -> DataFrame:
    """Probability, score and decision of every row; with ``explain``, ``attributions`` of its log-odds per feature."""

    def score(rows: DataFrame) -> DataFrame:
        rows = prepared(rows, "fraud", bundle.codes)
        rows = boosting.with_margin(rows, bundle.model, _inputs("fraud"), "_margin", "_moves" if explain else None)
        rows = scoring.with_decision(rows.withColumn("raw_probability", scoring.sigmoid(F.col("_margin"))), "raw_probability")
        return rows.withColumn("attributions", _attributions(bundle.model.features, F.col("_moves"))) if explain else rows

    added = ["raw_probability", "fraud_probability", "fraud_risk_score", "decision", "predicted_fraud"]
    return _beside(df, [*added, *(["attributions"] if explain else [])], score)


def wide_scores(packed: DataFrame, bundle: Bundle) -> DataFrame:
    """Probability, score and decision of every row of the packed wide table."""

    def score(rows: DataFrame) -> DataFrame:
        inputs = {f: F.col(f) for f in bundle.model.features}
        margins = boosting.with_margin(wide_rows(rows, bundle.model.features), bundle.model, inputs, "_margin")
        return scoring.with_decision(margins.withColumn("raw_probability", scoring.sigmoid(F.col("_margin"))), "raw_probability")

    return _beside(packed, ["raw_probability", "fraud_probability", "fraud_risk_score", "decision", "predicted_fraud"], score)


def anomaly_scores(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Raw score, 0-1 score, flag and share of the blend of every row."""
    return _beside(df, ["anomaly_raw", "is_anomaly", "anomaly_score", "anomaly_contribution"], lambda rows: anomaly.score(rows, bundle.model))


CREDIT_COLUMNS = ["model_component", "anomaly_component", "bureau_component", "credit_risk_score", "risk_band", "top_features"]


def credit_scores(df: DataFrame, bundle: Bundle, unusual: Bundle, gap_free: bool = False) -> DataFrame:
    """The composed credit score: regressor, forest and bureau signal, its components, band and the five features that moved the regressor most.

    ``df`` has the account's age as ``account_age_days``; missing features are filled.
    """
    if unusual.kind != "anomaly" or bundle.kind != "credit":
        raise ValueError("a credit score is composed of a credit model and an anomaly model")

    def score(rows: DataFrame) -> DataFrame:
        rows = anomaly_scores(rows, unusual)
        rows = prepared(rows, "credit", bundle.codes)
        rows = boosting.with_margin(rows, bundle.model, _inputs("credit"), "_margin", "_moves")
        rows = rows.withColumn("attributions", _attributions(bundle.model.features, F.col("_moves")))
        rows = scoring.top_attributions(rows, texts=CREDIT_DESCRIPTIONS)
        return credit.credit_index(rows, "_margin", "anomaly_score", gap_free=gap_free)

    return _beside(df, CREDIT_COLUMNS, score)


def with_credit(scored: DataFrame, bundle: Bundle, unusual: Bundle) -> DataFrame:
    """Fraud scores with the credit score and band of the same rows beside them."""
    rows = credit_scores(scored, bundle, unusual)
    added = ["credit_risk_score", "risk_band"]
    return rows.select(*[c for c in scored.columns if c not in added], *added)

