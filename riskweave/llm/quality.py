"""Quality classifier with hierarchical empirical Bayes over sites.

A document classifier gives each document a probability of good quality and one of being toxic: two logistic models over hashed
stems (the first ``STEM`` bytes of each word, and how often they stand there) and the shape of the text, fitted on at most ``SAMPLE`` labelled documents (those
with the smallest hash of their id). Toxic documents are few, so a model of three quarters of the sample puts the toxic head's threshold where ``FALSE_ALARMS`` of
the other documents in the last quarter lie above it. Its
evidence is then weighed with what is known about the place that a document comes from: Spark groups the probabilities by path and
host; a host's rate is shrunk toward the global rate, and a path's toward its host's, the more the fewer documents there are. The
strength of each shrinkage is estimated from the spread between hosts and between paths (method of moments). A document's
posterior odds are its own, times its path's odds over the global odds.

Documents have no URL: their host is the source, their path the language within it. A null host or path is a place of its own.

Only counts and sums per place leave the tasks, combined on the map side first, so a place with a third of all documents is no
burden. A null or empty text is judged by its (empty) shape. Repeated rows are judged alike; labels that are null or whose
document is missing are ignored, and of several labels for one id the lowest counts. Without labels of both kinds a model is flat and
rejects nothing. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, give_back, id_key, if_small, keyed_rows, stored
from riskweave.llm.text import Words, batches, mix
from riskweave.llm.tokens import forget_encoders

SAMPLE = 20_000
BUCKETS = 18
STEM = 6
FALSE_ALARMS = 0.01
HEADS = ("quality", "toxic")
SHAPES = 7
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_MARKS = np.zeros(256, dtype=np.int64)
_MARKS[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) not in ".,'-"]] = 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, bucket and count of every distinct stem of every text, and the texts' shapes."""
    plain, words = Words(texts), Words(texts, lower=True)
    n = words.counts()
    bare = words.bare_hash()
    _, first = np.unique(bare + mix(words.doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(words.doc[first], minlength=len(texts))
    bucket = (words.bare_hash(STEM) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    pairs, often = np.unique(words.doc * (1 << BUCKETS) + bucket, return_counts=True)
    doc, bucket = pairs >> BUCKETS, pairs & ((1 << BUCKETS) - 1)
    raw = np.frombuffer(plain.buffer, dtype=np.uint8)
    size = np.maximum(np.diff(plain.bounds) - 1, 1)
    upper = np.diff(np.concatenate([[0], np.cumsum(_UPPER[raw])])[plain.bounds]) / size
    marks = np.diff(np.concatenate([[0], np.cumsum(_MARKS[raw])])[plain.bounds]) / size
    same = np.zeros(len(bare) + 1, dtype=np.int64)
    same[1:] = np.cumsum(np.concatenate([[0], (bare[1:] == bare[:-1]) & (words.doc[1:] == words.doc[:-1])])) if len(bare) else 0
    again = np.diff(same[words.first]) / np.maximum(n, 1)
    fresh = distinct / np.maximum(n, 1)
    shape = np.stack([upper, marks, again, fresh, np.log1p(n), size / np.maximum(n, 1), np.log1p(marks * size)], axis=1)
    return doc, bucket, often, np.minimum(shape, 50.0)


@dataclass
class Linear:
    """Two logistic models: weights per bucket and per shape (after centring and scaling), and an intercept."""

    words: np.ndarray  # heads x buckets
    shapes: np.ndarray  # heads x shapes
    bias: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def logits(self, texts: list[str]) -> np.ndarray:
        doc, bucket, often, shape = features(texts)
        value = np.log1p(often)
        out = ((shape - self.centre) / self.scale) @ self.shapes.T + self.bias
        for h in range(len(HEADS)):
            out[:, h] += np.bincount(doc, self.words[h, bucket] * value, len(texts))
        return np.clip(out, -30, 30)


def flat() -> Linear:
    return Linear(
        np.zeros((2, 1 << BUCKETS), dtype=np.float32), np.zeros((2, SHAPES)), np.array([4.0, -4.0]), np.zeros(SHAPES), np.ones(SHAPES)
    )


def _blocks(bounds: np.ndarray, size: int = 1 << 17) -> list[tuple[int, int]]:
    """Ranges of neighbouring groups of about ``size`` entries; group i is the entries from ``bounds[i]`` to the next."""
    cuts = np.unique([0, *np.searchsorted(bounds, np.arange(size, bounds[-1], size)), len(bounds) - 1])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def train(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, shape: np.ndarray, targets: np.ndarray, rounds: int = 150) -> Linear:
    """Logistic regression by Adam over all rows at once, with a ridge, and the threshold that a part of them sets.

    Entries (``doc``, ``bucket``, ``value``) stand by document. A stem of one text says nothing about others, and is left out.
    Each round goes through them in blocks, so that it holds a few numbers per entry and no more.
    """
    model, n = flat(), len(shape)
    if not n:
        return model
    shared = np.bincount(bucket, minlength=1 << BUCKETS) > 1
    used, place = np.flatnonzero(shared), (np.cumsum(shared) - 1).astype(np.int32)
    keep = shared[bucket]
    doc, column, value = doc[keep].astype(np.int32), place[bucket[keep]], value[keep]
    order = np.argsort(column, kind="stable").astype(np.int32)
    doc_of, value_of = doc[order], value[order]
    begins = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(used)))])  # of each stem's entries
    first = np.searchsorted(doc, np.arange(n + 1))  # of each text's
    by_text, by_stem = _blocks(first), _blocks(begins)
    del order, keep, bucket
    model.centre, model.scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    x = (shape - model.centre) / model.scale

    def margins(w: np.ndarray) -> np.ndarray:
        out = x @ w[len(used) : -1] + w[-1]
        for a, b in by_text:
            low, high = first[a], first[b]
            out[a:b] += np.bincount(doc[low:high] - a, w[column[low:high]] * value[low:high], b - a)
        return out

    def stems_slope(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for a, b in by_stem:
            low, high = begins[a], begins[b]
            out[a:b] = np.add.reduceat(r[doc_of[low:high]] * value_of[low:high], begins[a:b] - low)
        return out

    def fitted(y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The weights from the rows that are marked."""
        many = rows.sum()
        rate = y[rows].mean()
        w = np.zeros(len(used) + SHAPES + 1)
        w[-1] = np.log(rate / (1 - rate))
        first, second = np.zeros_like(w), np.zeros_like(w)
        # the stems share one ridge with the number of texts, so that it does not fade as the sample grows
        ridge = np.full(len(w), 2.0 / many)
        ridge[-1] = 0.0
        for t in range(1, rounds + 1):
            r = rows * (1 / (1 + np.exp(-np.clip(margins(w), -30, 30))) - y) / many
            slope = np.concatenate([stems_slope(r), x.T @ r, [r.sum()]]) + ridge * w
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return w

    everything, held = np.ones(n, dtype=bool), np.arange(n) % 4 == 0
    for h in range(len(HEADS)):
        y = targets[:, h].astype(float)
        if not 0 < y.sum() < n:
            continue
        w = fitted(y, everything)
        if h == 1 and (y[~held] == 1).any() and (y[held] == 1).any() and (y[~held] == 0).any() and (y[held] == 0).any():
            w[-1] -= min(float(np.quantile(margins(fitted(y, ~held))[held & (y == 0)], 1 - FALSE_ALARMS)), 0.0)
        model.words[h, used] = w[: len(used)]
        model.shapes[h], model.bias[h] = w[len(used) : -1], w[-1]
    return model


def _feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget_encoders()
    for rows in frames:
        texts = rows["text"].fillna("").tolist()
        for low, high in batches(texts):
            doc, bucket, often, shape = features(texts[low:high])
            at = np.searchsorted(doc, np.arange(high - low + 1))
            part = rows.iloc[low:high]
            yield pd.DataFrame(
                {
                    "key": part["key"],
                    "quality": part["quality"], "toxic": part["toxic"],
                    "buckets": [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                    "values": [np.log1p(often[a:b]).astype(np.float32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                    "shape": list(shape),
                }
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear:
    """``labels``: doc_id, quality, toxic (0 or 1)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key"))
    known = known.agg(F.min("quality").cast("int").alias("quality"), F.min("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    # at most ``sample`` rows of three numbers
    rows = docs.select(id_key().alias("key"), "text").join(F.broadcast(chosen), "key")
    schema = "key long, quality int, toxic int, buckets binary, values binary, shape array<double>"
    table = rows.mapInPandas(_feature_rows, schema)
    # the sample is bounded and its fit needs some hundred MB: a task of its own, not the driver
    made = table.groupBy(F.lit(0).alias("all")).applyInPandas(_fitted_row, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else flat()


def _fitted_row(got: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"model": [pickle.dumps(_fitted(got))]})
    give_back()
    return out


def _fitted(got: pd.DataFrame) -> Linear:
    shape = np.stack(got["shape"].to_numpy())
    # rows that share an id: the one of the smallest shape
    order = np.lexsort((*shape.T[::-1], got["key"]))
    keep = order[~got["key"].iloc[order].duplicated().to_numpy()]
    bucket, value = ([np.frombuffer(x, dtype=kind) for x in got[name].to_numpy()[keep]] for name, kind in (("buckets", np.int32), ("values", np.float32)))
    doc = np.repeat(np.arange(len(keep), dtype=np.int32), [len(b) for b in bucket])
    return train(doc, np.concatenate(bucket), np.concatenate(value), shape[keep], got[list(HEADS)].to_numpy()[keep])


def scored(docs: DataFrame, model: Linear, host: Column, path: Column) -> DataFrame:
    """doc_id, text_hash, host, path and the classifier's two probabilities for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 x 2**BUCKETS weights

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        for rows in frames:
            texts = rows["text"].fillna("").tolist()
            for low, high in batches(texts):
                p = 1 / (1 + np.exp(-held.value.logits(texts[low:high])))
                part = rows.iloc[low:high].drop(columns="text").astype({"doc_id": "Int64"})
                yield part.assign(quality=p[:, 0], toxic=p[:, 1])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), host.cast("string").alias("host"),
        path.cast("string").alias("path"), "text",
    )
    schema = "doc_id long, text_hash long, host string, path string, quality double, toxic double"
    return slim.mapInPandas(rows_of, schema)


def _strength(rates: DataFrame, rate: str, centre: Column | float) -> float:
    """Pseudo-documents of a prior around ``centre``, from how far the rates of places with n documents lie from it."""
    c = centre if isinstance(centre, Column) else F.lit(centre)
    got = rates.agg(
        F.sum(F.col("n") * (F.col(rate) - c) ** 2).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("places"),
        F.sum(F.col("n") * c * (1 - c)).alias("noise"),
    ).first()
    if not got["n"]:
        return 1.0
    noise = got["noise"] / got["n"]
    between = max(0.0, (got["spread"] - got["places"] * noise) / got["n"])
    return float(np.clip(noise / between - 1, 1.0, 1e4)) if between > 0 else 1e4


def site_posteriors(rows: DataFrame, head: str) -> DataFrame:
    """host, path, the path's shrunk rate and the global rate of one head."""
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(head).alias("total"))
    paths = stored(paths, f"sites-{head}")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("rate", F.col("total") / F.col("n"))
    whole = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    overall = float(np.clip(whole if whole is not None else 0.5, 1e-4, 1 - 1e-4))
    k = _strength(hosts, "rate", overall)
    hosts = hosts.select(F.col("host").alias("at"), ((F.col("total") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    joined = paths.join(hosts, F.expr("host <=> at")).drop("at").withColumn("rate", F.col("total") / F.col("n"))
    k = _strength(joined, "rate", F.col("host_rate"))
    rate = (F.col("total") + k * F.col("host_rate")) / (F.col("n") + k)
    return joined.select("host", "path", F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4)).alias(f"{head}_site"), F.lit(overall).alias(f"{head}_all"))


def _odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def judged(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_hash, both probabilities, both posteriors and ``rejected`` for every row of ``docs`` (doc_id, text, source, lang)."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = stored(scored(docs, fit(docs, labels), host, path), "quality-scores")
    out = rows
    for head in HEADS:
        sites = site_posteriors(rows, head).withColumnsRenamed({"host": f"{head}_host", "path": f"{head}_path"})
        sites = if_small(stored(sites, f"posteriors-{head}"))
        out = out.join(sites, F.expr(f"host <=> {head}_host AND path <=> {head}_path"), "left")
        p = F.least(F.greatest(F.col(head), F.lit(1e-9)), F.lit(1 - 1e-9))
        odds = _odds(p) + _odds(F.col(f"{head}_site")) - _odds(F.col(f"{head}_all"))
        out = out.withColumn(f"{head}_posterior", 1 / (1 + F.exp(-odds)))
    rejected = (F.col("quality_posterior") < threshold) | (F.col("toxic_posterior") > threshold)
    return out.select("doc_id", "text_hash", "host", "path", *HEADS, *[f"{h}_posterior" for h in HEADS], rejected.alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    out = judged(docs, labels).where("rejected").select(id_key().alias("out_id"), F.col("text_hash").alias("out_hash")).distinct()
    return keyed_rows(docs).join(out, F.expr("id = out_id AND text_hash = out_hash"), "left_anti").select("row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")
