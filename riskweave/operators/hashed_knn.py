"""Near neighbours by random projections, with a measured recall.

A vector falls into the bucket that the signs of its random projections name, one in each table; ``fitted`` makes one table, so every vector is held once.
A query looks into its own bucket and those that differ where its projections lie closest to zero, likeliest first (``probes``). The number of buckets
grows with the corpus up to 2**``MAX_BITS``; one that holds too much for a task is cut into blocks, and each of its queries goes to all of them, so nothing
found is lost and no task gets more. Distances of what is found are exact, ties go to the smaller id.

What is found is most of the nearest, not all. ``fitted`` sets the number of buckets looked into: queries of a bounded sample are compared with the exact
neighbours over the whole corpus, and ``probes`` is the least that reaches ``goal``; all buckets reach it surely. Vectors without clusters ask for more than half
of the buckets. ``nearest`` in ``knn`` is the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import knn
from riskweave.operators.keyed import top_per_key

BUCKET_ROWS = 64
BLOCK_ROWS = 4_000
PROBES = 8
MAX_BITS = 8  # of a table; all its buckets are ranked for a query
_FOUND = "query_id long, corpus_id long, distance double"


@dataclass(frozen=True)
class Tables:
    """The planes of all tables, around the corpus' mean."""

    centre: np.ndarray
    planes: np.ndarray  # tables x bits x width
    probes: int = PROBES  # buckets of a table that a query looks into

    def buckets(self, points: np.ndarray, probes: int = 1) -> np.ndarray:
        """points x tables x probes: a vector's own bucket, then the likeliest others."""
        tables, bits, width = self.planes.shape
        out = np.zeros((len(points), tables, probes), dtype=np.int64)
        if not bits:
            return out[:, :, :1]
        sides = (points - self.centre) @ self.planes.reshape(-1, width).T
        sides = sides.reshape(len(points), tables, bits)
        own = (sides > 0) @ (1 << np.arange(bits, dtype=np.int64))
        if probes == 1:
            return own[:, :, None]
        flips = np.arange(1 << bits, dtype=np.int64)
        costs = sides**2 @ ((flips[:, None] >> np.arange(bits)) & 1).T.astype(float)
        return own[:, :, None] ^ np.argsort(costs, axis=2, kind="stable")[:, :, :probes]


def tables_for(corpus: DataFrame, tables: int, bucket_rows: int = BUCKET_ROWS, seed: int = 42) -> Tables | None:
    """Planes for a corpus of (id, vector), as many as its size asks for; None for an empty one."""
    shaped = knn._shaped(corpus)
    head = shaped.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not head["n"]:
        return None
    entries = shaped.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    centre = np.zeros(head["width"])
    for row in entries.collect():  # one row per entry of a vector
        centre[row["at"]] = row["x"]
    bits = max(0, int(np.ceil(np.log2(head["n"] / bucket_rows)))) if head["n"] > bucket_rows else 0
    return Tables(centre, np.random.default_rng(seed).normal(size=(tables, min(bits, MAX_BITS), head["width"])))


def _placed(vectors: DataFrame, made: Tables, probes: int) -> DataFrame:
    """id, vector and bucket (with its table in the upper bits), a row for every bucket that a vector is in or looks into."""
    held = vectors.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("array<long>")
    def buckets(column: pd.Series) -> pd.Series:
        found = held.value.buckets(np.stack(column.to_numpy()), probes)
        found = found + (np.arange(found.shape[1], dtype=np.int64) << 32)[None, :, None]
        return pd.Series(list(found.reshape(len(found), -1)))

    return vectors.select("id", "vector", F.explode(buckets("vector")).alias("bucket"))


def nearest_hashed(queries: DataFrame, corpus: DataFrame, made: Tables | None, k: int = 3, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, position, corpus_id, distance), up to ``k`` for every query; squared L2. Vectors that are null take no part."""
    queries, corpus = knn._shaped(queries), knn._shaped(corpus)
    if made is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, position int, corpus_id long, distance double")
    held, asked = _placed(corpus, made, 1), _placed(queries, made, made.probes if probes is None else probes)
    keys = ["bucket"]
    # only buckets that hold too much for one task are named here
    heavy = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
    blocks = heavy.select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    many = F.coalesce("blocks", F.lit(1))
    left = asked.join(blocks, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), many - 1))).drop("blocks")
    right = held.join(blocks, keys, "left").withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int")).drop("blocks")
    grouped = [*keys, "block"]
    found = left.groupBy(*grouped).cogroup(right.groupBy(*grouped)).applyInPandas(knn.match(k), _FOUND)
    # a neighbour may be met in several tables
    return top_per_key(found.distinct(), ["query_id"], [F.col("distance"), F.col("corpus_id")], k, rank="position").select(
        "query_id", "position", "corpus_id", "distance"
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, exact neighbours, and the share of them that was found or tied with something found."""
    worst = exact.groupBy("query_id").agg(F.max("distance").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    hits = found.join(worst, "query_id").filter(F.col("distance") <= F.col("_worst")).groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    each = worst.join(hits, "query_id", "left")
    share = F.try_divide(F.sum(F.least(F.coalesce("_hits", F.lit(0)), F.col("_n"))), F.sum("_n"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_exact"), share.alias("recall"))


def fitted(corpus: DataFrame, k: int = 3, goal: float = 0.9, sample: int = 200, bucket_rows: int = BUCKET_ROWS) -> tuple[Tables | None, float]:
    """A table whose ``probes`` find ``goal`` of the exact neighbours of ``sample`` vectors (those with the smallest hash of their id), and the measured share."""
    made = tables_for(corpus, 1, bucket_rows)
    if made is None:
        return None, 1.0
    shaped = knn._shaped(corpus)
    asked = shaped.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most k vectors of each query of the sample
    pairs = knn.nearest(asked, corpus, k).join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    pairs = shaped.join(F.broadcast(pairs), F.col("id") == F.col("corpus_id")).select("query", "vector").collect()
    query, vector = (np.array([r[name] for r in pairs], dtype=float) for name in ("query", "vector"))
    ranked = made.buckets(query, 1 << made.planes.shape[1])[:, 0]
    rank = np.sort((ranked == made.buckets(vector)[:, 0]).argmax(axis=1))
    probes = int(rank[max(0, int(np.ceil(goal * len(rank))) - 1)]) + 1
    return replace(made, probes=probes), float((rank < probes).mean())
