"""Gradient-boosted trees: fits on bounded samples, many at once, and scores whole tables.

A fit sees a sample of rows (``sample_rows``, a parameter) with its features cut into at most ``BINS`` quantile bins, so it is one task of
fixed size whatever the table holds, and the trials of a search are rows that Spark spreads over the cluster. Trees grow level by level on
second-order gradients, with shrinkage, row and column subsampling, leaf weights held back by L1 and L2 terms, and a weight for rare positives. A
model has ``trees`` x (2 ** (depth + 1) - 1) nodes at most: a proven bound, which makes it safe to broadcast for scoring.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64
_LEAVES = 64  # of a tree, a bit of one word each
_CELLS = 8_192  # of two features together
_CHUNK = 4_096
_ALL, _ONE = ~np.uint64(0), np.uint64(1)
_PART = "part string, position int, value array<double>"


@dataclass(frozen=True)
class Settings:
    """What a fit may vary; the names are those of the search space."""

    n_estimators: int = 300
    max_depth: int = 5
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    scale_pos_weight: float = 1.0
    seed: int = 42


@dataclass
class Ensemble:
    """Trees as arrays of (tree, node); node i has the children 2i+1 and 2i+2, and feature -1 marks a leaf.

    ``value`` is what a tree would add if it ended at the node, so the steps along a path say what each feature adds.
    """

    features: list[str]
    base: float
    logistic: bool
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    settings: dict = field(default_factory=dict)

    def margins(self, points: np.ndarray, paths: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Sum over the trees per row, and per row and feature what its splits moved the sum by."""
        if self.feature.shape[1] > 2 * _LEAVES - 1:
            return self._walked(points, paths)
        total = np.full(len(points), self.base)
        moved = np.zeros((len(points), len(self.features))) if paths else None
        for i in range(0, len(points), _CHUNK):
            part = slice(i, i + _CHUNK)
            cells = [_cells(points[part], columns, edges) for columns, edges in self._plan.groups]
            size = len(total[part])
            left, more = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.uint64)
            for masks, values, moves in self._plan.trees:
                left.fill(_ALL)
                for group, mask in masks:
                    # cells are in range: clipping only spares numpy a copy
                    np.take(mask, cells[group], out=more, mode="clip")
                    left &= more
                # the leaf is the first that no split rules out: the number of zeros below the lowest one
                np.subtract(left, _ONE, out=more)
                np.invert(left, out=left)
                left &= more
                leaf = np.bitwise_count(left).astype(np.int64)
                total[part] += values.take(leaf, mode="clip")
                if paths:
                    moved[part] += moves.take(leaf, axis=0, mode="clip")
        return total, moved

    @cached_property
    def _plan(self) -> _Plan:
        """Per tree and cell of two features' values, a bit for each leaf that a row there may still end at."""
        cuts = [np.unique(self.threshold[self.feature == f]) for f in range(len(self.features))]
        used = [f for f in range(len(self.features)) if len(cuts[f])]
        groups, f = [], 0
        while f < len(used):
            pair = used[f : f + 2]
            if len(pair) == 2 and (len(cuts[pair[0]]) + 1) * (len(cuts[pair[1]]) + 1) > _CELLS:
                pair = pair[:1]
            groups.append((pair, [cuts[x] for x in pair]))
            f += len(pair)
        trees = []
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            leaves, ruled = _leaves(feature)
            moves = np.zeros((len(leaves), len(self.features)))
            for i, leaf in enumerate(leaves):
                while leaf:
                    above = (leaf - 1) // 2
                    moves[i, feature[above]] += value[leaf] - value[above]
                    leaf = above
            masks = []
            for number, (columns, edges) in enumerate(groups):
                sides = []
                for f, cut in zip(columns, edges, strict=True):
                    side = np.full(len(cut) + 1, _ALL)
                    for node in np.flatnonzero(feature == f):
                        if node in ruled:
                            right = np.arange(len(side)) > np.searchsorted(cut, threshold[node])
                            side &= np.where(right, ~ruled[node][0], ~ruled[node][1])
                    sides.append(side)
                mask = sides[0] if len(sides) == 1 else (sides[0][:, None] & sides[1][None, :]).ravel()
                if (mask != _ALL).any():
                    masks.append((number, mask))
            trees.append((masks, value[leaves], moves))
        return _Plan(groups, trees)

    def _walked(self, points: np.ndarray, paths: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The same from node to node, for deeper trees."""
        rows = np.arange(len(points))
        total = np.full(len(points), self.base)
        moved = np.zeros((len(points), len(self.features))) if paths else None
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(points), dtype=np.int64)
            for _ in range(depth):
                on = feature[at]
                inner = on >= 0
                if not inner.any():
                    break
                right = ~(points[rows, np.maximum(on, 0)] <= threshold[at])
                below = np.where(inner, 2 * at + 1 + right, at)
                if paths:
                    step = value[below] - value[at]
                    np.add.at(moved, (rows[inner], on[inner]), step[inner])
                at = below
            total += value[at]
        return total, moved

    def expected(self) -> float:
        """The margin before any split."""
        return self.base + float(self.value[:, 0].sum()) if len(self.value) else self.base


@dataclass(frozen=True)
class _Plan:
    groups: list  # features whose cells are found together, and their cuts
    trees: list  # masks by group, the leaves' values, and what each leaf's path moves every feature by


def _cells(points: np.ndarray, columns: list[int], edges: list[np.ndarray]) -> np.ndarray:
    """A value up to a cut lies left of it; what is missing lies right of all."""
    out = np.zeros(len(points), dtype=np.int64)
    for f, cut in zip(columns, edges, strict=True):
        x = points[:, f]
        out = out * (len(cut) + 1) + np.where(np.isnan(x), len(cut), np.searchsorted(cut, x, side="left"))
    return out


def _leaves(feature: np.ndarray) -> tuple[list[int], dict[int, tuple[np.uint64, np.uint64]]]:
    """The leaves from left to right, and per split the bits of those below its left and below its right child."""
    leaves, ruled = [], {}

    def visit(node: int) -> int:
        if feature[node] < 0 or 2 * node + 2 >= len(feature):
            leaves.append(node)
            return 1 << (len(leaves) - 1)
        left, right = visit(2 * node + 1), visit(2 * node + 2)
        ruled[node] = (np.uint64(left), np.uint64(right))
        return left | right

    visit(0)
    return leaves, ruled


# --- fitting, inside one task -----------------------------------------------------------------------------------------


def bin_edges(points: np.ndarray) -> list[np.ndarray]:
    """Cut points per feature: a value up to edge b lies in bin b or below. Missing values lie above all."""
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[~np.isnan(x)], shares, method="lower")) if (~np.isnan(x)).any() else np.zeros(0) for x in points.T]


def _shrunk(gradient: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> tuple:
    """One tree from the binned rows that take part."""
    width = 2 ** (s.max_depth + 1) - 1
    feature, threshold, value = np.full(width, -1), np.zeros(width), np.zeros(width)
    node = np.zeros(len(codes), dtype=np.int64)
    offset = np.arange(codes.shape[1]) * BINS
    usable = np.zeros((codes.shape[1], BINS), dtype=bool)
    for f in columns:
        usable[f, : len(edges[f])] = True
    for level in range(s.max_depth + 1):
        first, nodes = 2**level - 1, 2**level
        here = node >= first
        if not here.any():
            break
        of = node[here] - first
        gs, hs = np.bincount(of, g[here], nodes), np.bincount(of, h[here], nodes)
        value[first : first + nodes] = -s.learning_rate * _shrunk(gs, s.reg_alpha) / np.maximum(hs + s.reg_lambda, 1e-12)
        if level == s.max_depth:
            break
        cell = (of[:, None] * (codes.shape[1] * BINS) + offset + codes[here]).ravel()
        shape = (nodes, codes.shape[1], BINS)
        left_g = np.bincount(cell, np.repeat(g[here], codes.shape[1]), np.prod(shape)).reshape(shape).cumsum(axis=2)
        left_h = np.bincount(cell, np.repeat(h[here], codes.shape[1]), np.prod(shape)).reshape(shape).cumsum(axis=2)
        right_g, right_h = gs[:, None, None] - left_g, hs[:, None, None] - left_h

        def worth(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
            return _shrunk(gradient, s.reg_alpha) ** 2 / np.maximum(weight + s.reg_lambda, 1e-12)

        gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(gs, hs)[:, None, None]
        gain[:, ~usable] = -np.inf
        gain[(left_h < s.min_child_weight) | (right_h < s.min_child_weight) | (left_h <= 0) | (right_h <= 0)] = -np.inf
        best = gain.reshape(nodes, -1).argmax(axis=1)
        split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
        on, cut = best // BINS, best % BINS
        for i in np.flatnonzero(split).tolist():
            feature[first + i], threshold[first + i] = on[i], edges[on[i]][cut[i]]
        rows = np.flatnonzero(here)
        rows, of = rows[split[of]], of[split[of]]
        node[rows] = 2 * node[rows] + 1 + (codes[rows, on[of]] > cut[of])
        # rows of leaves stay where they are, below the next level's first node
    return feature, threshold, value


def fit(points: np.ndarray, label: np.ndarray, features: list[str], logistic: bool, s: Settings) -> Ensemble:
    """Boosted trees for a label of 0 and 1 (``logistic``) or a number; the same for the same rows in the same order."""
    rng = np.random.default_rng(s.seed)
    edges = bin_edges(points)
    codes = np.stack([np.where(np.isnan(x), BINS - 1, np.searchsorted(e, x, side="left")) for x, e in zip(points.T, edges, strict=True)], axis=1)
    weight = np.where(label == 1, s.scale_pos_weight, 1.0) if logistic else np.ones(len(label))
    mean = float((weight * label).sum() / weight.sum())
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))) if logistic else mean
    margin = np.full(len(label), base)
    trees = []
    kept = max(1, round(s.colsample_bytree * len(features)))
    for _ in range(s.n_estimators):
        if logistic:
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - label), weight * p * (1 - p)
        else:
            g, h = margin - label, np.ones(len(label))
        rows = np.flatnonzero(rng.random(len(label)) < s.subsample) if s.subsample < 1 else np.arange(len(label))
        if not len(rows):
            rows = np.arange(len(label))
        columns = rng.choice(len(features), kept, replace=False)
        tree = _grow(codes[rows], edges, g[rows], h[rows], columns, s)
        trees.append(tree)
        margin += _one_tree(tree, points)
    arrays = [np.stack(x) if trees else np.zeros((0, 1)) for x in (zip(*trees, strict=True) if trees else ((), (), ()))]
    return Ensemble(features, base, logistic, arrays[0].astype(np.int64), arrays[1], arrays[2], asdict(s))


def _one_tree(tree: tuple, points: np.ndarray) -> np.ndarray:
    alone = Ensemble([], 0.0, False, tree[0][None], tree[1][None], tree[2][None])
    return alone._walked(points)[0]


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve; ties count half. NaN without both kinds of rows."""
    order = np.argsort(score, kind="stable")
    ranked, new = score[order], np.ones(len(score), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(score))
    rank = np.empty(len(score))
    rank[order] = np.repeat((first + last + 1) / 2, last - first)
    good = label == 1
    n, m = int(good.sum()), int((~good).sum())
    return float((rank[good].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


# --- on Spark ---------------------------------------------------------------------------------------------------------


def sample_rows(df: DataFrame, key: str, features: list[str], label: str, rows: int) -> pd.DataFrame:
    """At most ``rows`` rows as numbers, those with the smallest md5 of their key: the same on every run, in the same order."""
    slim = df.select(F.md5(F.col(key).cast("string")).alias("_at"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_label"))
    return slim.where("_label IS NOT NULL").orderBy("_at", *features, "_label").limit(rows).toPandas().drop(columns="_at")


def fit_on(df: DataFrame, key: str, features: list[str], label: str, logistic: bool, settings: Settings, rows: int) -> Ensemble:
    """A fit on a bounded sample of ``df``, as a job of one task."""
    train = sample_rows(df, key, features, label, rows)
    if not len(train):
        raise ValueError("no rows to train on")
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(train)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows_ = held.value
                yield _parts(fit(rows_[features].to_numpy(float), rows_["_label"].to_numpy(float), features, logistic, settings))

    return from_parts(spark.range(1).mapInPandas(run, _PART), features, logistic, asdict(settings))


def _parts(model: Ensemble) -> pd.DataFrame:
    out = [{"part": "base", "position": 0, "value": [model.base]}]
    for name in ("feature", "threshold", "value"):
        out += [{"part": name, "position": i, "value": row.astype(float).tolist()} for i, row in enumerate(getattr(model, name))]
    return pd.DataFrame(out)


def parts_table(spark, model: Ensemble) -> DataFrame:
    """The model as a table, a row per tree and array; bounded like the model."""
    return spark.createDataFrame(_parts(model), _PART)


def from_parts(parts: DataFrame, features: list[str], logistic: bool, settings: dict | None = None) -> Ensemble:
    rows = parts.toPandas()

    def array(name: str) -> np.ndarray:
        found = rows[rows["part"] == name].sort_values("position")["value"].tolist()
        return np.stack([np.asarray(x, dtype=float) for x in found]) if found else np.zeros((0, 1))

    base = float(rows[rows["part"] == "base"]["value"].iloc[0][0])
    return Ensemble(list(features), base, logistic, array("feature").astype(np.int64), array("threshold"), array("value"), settings or {})


def with_margin(df: DataFrame, model: Ensemble, inputs: dict[str, Column], name: str = "margin", paths: str | None = None) -> DataFrame:
    """Add the model's margin per row, and as ``paths`` what each feature moved it by, in feature order.

    The moves and the margin before any split add up to the margin.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = "struct<margin:double,moves:array<double>>" if paths else "double"

    @F.pandas_udf(kind)
    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, moved = held.value.margins(batch[held.value.features].to_numpy(float), bool(paths))
            yield pd.DataFrame({"margin": total, "moves": list(moved)}) if paths else pd.Series(total)

    out = margins(F.struct(*[inputs[f].cast("double").alias(f) for f in model.features]))
    if not paths:
        return df.withColumn(name, out)
    return df.withColumn("_margins", out).withColumn(name, F.col("_margins.margin")).withColumn(paths, F.col("_margins.moves")).drop("_margins")


def search(
    train: pd.DataFrame, validation: pd.DataFrame, spark, features: list[str], logistic: bool, trials: list[Settings]
) -> list[dict]:
    """Every trial's settings with its score on the validation rows (AUC, or minus the mean absolute error), best first.

    Both samples are bounded and broadcast; each trial is a row of its own, so as many run at once as there are cores.
    """
    held = spark.sparkContext.broadcast((train, validation))
    rows = [(i, json.dumps(asdict(s))) for i, s in enumerate(trials)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, text in zip(frame["trial"], frame["settings"], strict=True):
                known, other = held.value
                model = fit(known[features].to_numpy(float), known["_label"].to_numpy(float), features, logistic, Settings(**json.loads(text)))
                guess, truth = model.margins(other[features].to_numpy(float))[0], other["_label"].to_numpy(float)
                score = auc(guess, truth) if logistic else -float(np.abs(np.clip(guess, 0, 1) - truth).mean())
                yield pd.DataFrame({"trial": [number], "settings": [text], "score": [score]})

    spread = spark.createDataFrame(rows, "trial int, settings string").repartition(len(rows), "trial")
    found = spread.mapInPandas(run, "trial int, settings string, score double").collect()  # bounded: one row per trial
    held.destroy()
    # a score may be missing (NaN): such trials come last
    ordered = sorted(found, key=lambda r: (r["score"] != r["score"], -r["score"], r["trial"]))
    return [{"trial": r["trial"], "score": r["score"], "settings": json.loads(r["settings"])} for r in ordered]
