"""Isolation forest: distributed sampling and scoring, one small group per tree.

Each tree sees ``sample`` rows, so a tree is built from a group of fixed size
whatever the table holds, and the whole forest has at most
``trees * (2 * sample - 1)`` nodes: a proven bound that makes it safe to
broadcast for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.keyed import top_per_key

_NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


@dataclass
class Forest:
    features: list[str]
    means: list[float]
    scales: list[float]
    sample: int
    nodes: dict[str, np.ndarray]  # (trees, nodes) arrays
    depth: int
    offset: float = float("nan")


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw_samples(df: DataFrame, key: str, rows: int, trees: int, sample: int) -> DataFrame:
    """(tree, draw, row...) with at most ``sample`` rows per tree.

    Draws are hashes of the key, hence repeatable. A row draws its trees by
    itself, each with the same chance, which thins candidates to about twice
    the need before anything is shuffled; a row may join several trees. The
    rule is the same at every size of the table.
    """
    full = float(2**63)

    def unit(*parts):
        return F.xxhash64(*parts).cast("double") / full / 2 + 0.5

    share = min(1.0, 2.0 * sample / max(rows, 1))
    joins = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: unit(F.col(key), tree) < share)
    drawn = df.withColumn("tree", F.explode(joins))
    drawn = drawn.withColumn("draw", F.xxhash64(F.col(key), F.col("tree"), F.lit("order")))
    return top_per_key(drawn, ["tree"], [F.col("draw"), F.col(key)], sample)


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as (feature, threshold, left, right, path length)."""
    nodes: list[tuple] = [()]
    todo = [(0, points, 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, at, at, depth + average_path(len(rows)))
            continue
        feature = int(rng.choice(usable))
        cut = rng.uniform(low[feature], high[feature])
        goes_left = rows[:, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (feature, cut, left, right, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def fit_forest(
    df: DataFrame,
    key: str,
    features: list[str],
    trees: int = 200,
    sample: int = 256,
    contamination: float = 0.02,
    seed: int = 42,
) -> Forest:
    """Train on standardised rows and set the flag offset from their scores."""
    numeric = df.select(F.col(key), *[F.col(f).cast("double").alias(f) for f in features])
    stats = numeric.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    if not stats["n"]:
        raise ValueError("no rows to train on")
    means = [stats[f"m_{f}"] for f in features]
    scales = [stats[f"s_{f}"] or 1.0 for f in features]
    size = min(sample, stats["n"])
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("draw")
        points = (ordered[features].to_numpy(float) - means) / scales
        grown = _grow(points, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["feature", "threshold", "left", "right", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    drawn = draw_samples(numeric, key, stats["n"], trees, sample)
    # bounded: trees * (2 * sample - 1) rows
    rows = drawn.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
    forest = Forest(features, means, scales, size, _pack(rows), limit)
    offset = forest_scores(numeric, forest).agg(F.percentile_approx("anomaly_raw", contamination, 100000).alias("q"))
    forest.offset = offset.first()["q"]
    return forest


def _pack(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    ids = {t: i for i, t in enumerate(sorted(rows["tree"].unique()))}
    width = int(rows["node"].max()) + 1
    at = (rows["tree"].map(ids).to_numpy(), rows["node"].to_numpy())
    packed = {}
    for name, kind in (("feature", int), ("threshold", float), ("left", int), ("right", int), ("length", float)):
        packed[name] = np.zeros((len(ids), width), dtype=kind)
        packed[name][at] = rows[name].to_numpy()
    return packed


def _mean_length(points: np.ndarray, forest: Forest) -> np.ndarray:
    """Mean path length per row; one tree at a time keeps its nodes in cache."""
    nodes = forest.nodes
    flat = np.ascontiguousarray(points).ravel()
    base = np.arange(len(points)) * points.shape[1]
    total = np.zeros(len(points))
    trees = nodes["feature"].shape[0]
    for t in range(trees):
        feature, threshold = np.maximum(nodes["feature"][t], 0), nodes["threshold"][t]
        # children side by side: the comparison picks the column
        child = np.stack([nodes["right"][t], nodes["left"][t]], axis=1).ravel()
        at = np.zeros(len(points), dtype=np.int64)
        for _ in range(forest.depth):
            goes_left = flat.take(base + feature.take(at)) <= threshold.take(at)
            at = child.take(2 * at + goes_left)
        total += nodes["length"][t].take(at)
    return total / trees


def forest_scores(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly_raw``: -2^(-E[path] / c(sample)); lower is stranger."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = shared.value
        norm = average_path(model.sample) or 1.0
        for batch in batches:
            points = (batch[model.features].to_numpy(float) - model.means) / model.scales
            yield pd.Series(-np.exp2(-_mean_length(points, model) / norm))

    columns = [F.col(f).cast("double").alias(f) for f in forest.features]
    return df.withColumn("anomaly_raw", raw(F.struct(*columns)))
