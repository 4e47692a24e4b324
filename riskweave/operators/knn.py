"""Exact k nearest vectors.

A bounded set of queries is broadcast and the corpus scanned once, keeping k
candidates per query and task. A larger set is joined by cells around pivots:
the triangle inequality rules out cells that cannot hold a neighbour, and hot
cells are cut into blocks. Where that rules out little, as a sample of the
queries tells, tiles of packed queries meet tiles of the packed corpus, each
once. All emit k rows per query and block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.keyed import top_per_key

BROADCAST_VALUES = 2_000_000  # vector entries, 16 MB as doubles
BLOCK_ROWS = 20_000
TILE_VALUES = 2_000_000  # vector entries of a tile
SCAN_SHARE = 0.1  # of the corpus in a query's cells, beyond which tiles move less
_PACK_VALUES = 16_384  # vector entries of a packed row
_SHARE_SAMPLE = 256
_SIDE = 2_048  # queries, and corpus rows, compared at once
_SPARSE = 32  # candidates a query, up to which they are looked at one by one
_DIGITS = 9
_LAST = np.iinfo("int64").max


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2", broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """(query_id, position, corpus_id, distance) for every query.

    ``queries`` and ``corpus`` have columns ``id`` (long) and ``vector``
    (array). Distance is squared L2, or 1 - cosine; ties go to the smaller id.
    """
    queries, corpus = _shaped(queries), _shaped(corpus)
    if metric == "cosine":
        queries, corpus = _unit(queries), _unit(corpus)
    head = queries.select(F.size("vector").alias("width")).limit(1).collect()
    room = max(1, broadcast_values // max(1, head[0]["width"])) if head else 1
    rows = queries.limit(room + 1).collect()
    found = _scan(rows, corpus, k) if len(rows) <= room else _by_cells(queries, corpus, k, most_share=SCAN_SHARE)
    ranked = top_per_key(found, ["query_id"], [F.col("distance"), F.col("corpus_id")], k, rank="position")
    distance = F.col("distance") / 2 if metric == "cosine" else F.col("distance")
    return ranked.select("query_id", "position", "corpus_id", distance.alias("distance"))


def _shaped(df: DataFrame) -> DataFrame:
    vector = F.col("vector").cast("array<double>")
    return df.select(F.col("id").cast("long").alias("id"), vector.alias("vector")).filter(F.col("vector").isNotNull())


def _unit(df: DataFrame) -> DataFrame:
    """Unit vectors: squared L2 between them is 2 (1 - cosine)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    length = F.when(norm > 0, norm).otherwise(1.0)
    return df.withColumn("_n", length).select("id", F.transform("vector", lambda x: x / F.col("_n")).alias("vector"))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that copies tie exactly."""
    squared = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * (left @ right.T)
    return np.round(np.maximum(squared, 0.0), _DIGITS)


class _Nearest:
    """The ``k`` nearest of some points among all vectors shown to them; ties go to the smaller id.

    Products in single precision, with room for their error, tell which pairs can matter; the distances of those are exact.
    """

    def __init__(self, points: np.ndarray, k: int):
        self.points, self.k = points, k
        self.squares = (points**2).sum(axis=1)
        self.ids = np.full((len(points), k), _LAST)
        self.near = np.full((len(points), k), np.inf)

    def show(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        squares = (vectors**2).sum(axis=1)
        size = float(max(np.nan_to_num(x).max(initial=0.0) for x in (self.squares, squares)))
        kind = np.float32 if size < 1e30 else np.float64
        asked = np.hstack([self.points, np.ones((len(self.points), 1))]).astype(kind)
        # asked @ held = (|q|^2 - distance) / 2
        held = np.hstack([vectors, -squares[:, None] / 2]).astype(kind)
        room = size * (len(held[0]) + 16) * float(np.finfo(kind).eps) + 10.0**-_DIGITS
        for i in range(0, len(held), _SIDE):
            columns = slice(i, i + _SIDE)
            for j in range(0, len(asked), _SIDE):
                rows = slice(j, j + _SIDE)
                border = self.near[rows, -1]
                if np.isfinite(border).all():
                    least = ((self.squares[rows] - border) / 2 - room).astype(kind)
                    hits = np.flatnonzero(asked[rows] @ held[columns].T >= least[:, None])
                    if not len(hits):
                        continue
                    q, c = np.divmod(hits, len(held[columns]))
                    often = np.bincount(q, minlength=len(border))
                    some = often[q] <= _SPARSE
                    self._take(q[some] + j, c[some] + i, ids, vectors, squares)
                    crowded = np.flatnonzero(often > _SPARSE) + j
                else:
                    crowded = np.arange(j, j + len(border))
                if len(crowded):
                    self._take_best(crowded, ids[columns], vectors[columns])

    def _take(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray) -> None:
        """Pairs of a query and a vector."""
        exact = self.squares[q] + squares[c] - 2.0 * np.einsum("ij,ij->i", self.points[q], vectors[c])
        met = np.unique(q)
        all_q = np.concatenate([np.repeat(met, self.k), q])
        all_ids = np.concatenate([self.ids[met].ravel(), ids[c]])
        all_near = np.concatenate([self.near[met].ravel(), np.round(np.maximum(exact, 0.0), _DIGITS)])
        order = np.lexsort((all_ids, all_near, all_q))
        first = np.searchsorted(all_q[order], met)
        best = order[first[:, None] + np.arange(self.k)]
        self.ids[met], self.near[met] = all_ids[best], all_near[best]

    def _take_best(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """All vectors of a block, which stand by id: the least distance that comes first is the one to take."""
        left = _distances(self.points[q], vectors)
        left[np.isnan(left)] = np.inf
        at = np.arange(len(q))
        all_ids, all_near = [self.ids[q]], [self.near[q]]
        for _ in range(min(self.k, len(ids))):
            best = left.argmin(axis=1)
            all_ids.append(ids[best][:, None])
            all_near.append(left[at, best][:, None])
            left[at, best] = np.inf
        all_ids, all_near = np.hstack(all_ids), np.hstack(all_near)
        order = np.lexsort((all_ids, all_near), axis=1)[:, : self.k]
        self.ids[q], self.near[q] = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_near, order, axis=1)

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        found = np.isfinite(self.near).ravel()
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.asarray(query_ids, dtype="int64"), self.k)[found],
                "corpus_id": self.ids.ravel()[found],
                "distance": self.near.ravel()[found],
            }
        )


def match(k: int):
    """For two frames of id and vector: the ``k`` nearest of the second for each row of the first."""

    def matched(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return _Nearest(np.zeros((0, 1)), k).frame([])
        found = _Nearest(np.stack(asking["vector"].to_numpy()), k)
        found.show(held["id"].to_numpy(), np.stack(held["vector"].to_numpy()))
        return found.frame(asking["id"].to_numpy())

    return matched


_FOUND = "query_id long, corpus_id long, distance double"


def _scan(rows: list, corpus: DataFrame, k: int) -> DataFrame:
    """Queries broadcast, corpus read once, k candidates per query and task."""
    spark = corpus.sparkSession
    if not rows:
        return spark.createDataFrame([], _FOUND)
    shared = spark.sparkContext.broadcast(
        (np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows], dtype=float))
    )

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, points = shared.value
        found = _Nearest(points, k)
        for batch in batches:
            if len(batch):
                found.show(batch["id"].to_numpy(), np.stack(batch["vector"].to_numpy()))
        yield found.frame(query_ids)

    return corpus.mapInPandas(local, _FOUND)


def _by_cells(
    queries: DataFrame, corpus: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS, most_share: float = 1.0
) -> DataFrame:
    """Pivot cells with exact pruning; group sizes stay near ``block_rows``.

    Tiles instead, if the cells of a sample of the queries hold more than ``most_share`` of the corpus.
    """
    spark = corpus.sparkSession
    if pivots is None:
        pivots = min(1024, max(4, math.isqrt(corpus.count()) // 4))
    chosen = corpus.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], _FOUND)
    centres = spark.sparkContext.broadcast(np.array([r["vector"] for r in chosen], dtype=float))

    @F.pandas_udf("cell int, radius double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        gaps = np.sqrt(_distances(np.stack(vectors.to_numpy()), centres.value))
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": gaps[np.arange(len(cell)), cell]})

    celled = corpus.withColumn("_at", assign("vector")).select("id", "vector", "_at.cell", "_at.radius")
    # at most one row per pivot
    shape = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).collect()
    cells = np.array([s["cell"] for s in shape])
    sizes = np.array([s["n"] for s in shape])
    radii = np.array([s["r"] for s in shape])

    def may_hold(points: np.ndarray) -> np.ndarray:
        gaps = np.sqrt(_distances(points, centres.value[cells]))
        reach = gaps + radii
        order = reach.argsort(axis=1)
        enough = (np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())).argmax(axis=1)
        # k vectors surely lie within this distance
        bound = np.take_along_axis(reach, order, axis=1)[np.arange(len(gaps)), enough]
        # the slack covers the distance rounding, which the root enlarges
        return gaps - radii <= bound[:, None] * (1 + 1e-6) + 1e-4

    if most_share < 1.0:
        some = queries.orderBy(F.xxhash64("id"), "id").limit(_SHARE_SAMPLE).collect()
        if some and (may_hold(np.array([r["vector"] for r in some], dtype=float)) @ sizes).mean() > most_share * sizes.sum():
            return _by_tiles(queries, corpus, k, int(sizes.sum()))

    @F.pandas_udf("array<int>")
    def candidates(vectors: pd.Series) -> pd.Series:
        return pd.Series([cells[row].tolist() for row in may_hold(np.stack(vectors.to_numpy()))])

    asked = queries.select("id", "vector", F.explode(candidates("vector")).alias("cell"))
    demand = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    blocks = {int(c): int(-(-n // block_rows)) for c, n in zip(cells, sizes, strict=True)}
    parts = {c: max(1, -(-demand.get(c, 0) // block_rows)) for c in blocks}

    def lookup(table: dict[int, int]):
        pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
        return F.element_at(pairs, F.col("cell"))

    def spread(count):
        return F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))

    left = (
        asked.withColumn("part", F.pmod(F.xxhash64("id"), lookup(parts)).cast("int"))
        .withColumn("block", spread(lookup(blocks)))
    )
    right = (
        celled.drop("radius")
        .withColumn("block", F.pmod(F.xxhash64("id"), lookup(blocks)).cast("int"))
        .withColumn("part", spread(lookup(parts)))
    )

    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match(k), _FOUND)


def _packed(vectors: DataFrame, tiles: int) -> DataFrame:
    """tile, n, ids and points: some hundred vectors a row, as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids, points = batch["id"].to_numpy(dtype="int64"), np.stack(batch["vector"].to_numpy()).astype(float)
            starts = range(0, len(ids), max(1, _PACK_VALUES // max(1, points.shape[1])))
            ends = [*starts[1:], len(ids)]
            yield pd.DataFrame(
                {
                    "n": [b - a for a, b in zip(starts, ends, strict=True)],
                    "ids": [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                    "points": [points[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                }
            )

    rows = vectors.mapInPandas(pack, "n long, ids binary, points binary")
    return rows.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int"))


def _by_tiles(queries: DataFrame, corpus: DataFrame, k: int, corpus_rows: int, tile_values: int = TILE_VALUES) -> DataFrame:
    """Every query against every vector: each tile of the one side meets each tile of the other in one group."""
    head = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    rows = max(1, tile_values // max(1, head["width"] or 1))
    parts, blocks = max(1, -(-head["n"] // rows)), max(1, -(-corpus_rows // rows))
    left = _packed(queries, parts).withColumnRenamed("tile", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = _packed(corpus, blocks).withColumnRenamed("tile", "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def opened(packs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, points = (np.frombuffer(b"".join(packs[name]), dtype=kind) for name, kind in (("ids", "int64"), ("points", "float64")))
        return ids, points.reshape(len(ids), -1)

    def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return _Nearest(np.zeros((0, 1)), k).frame([])
        query_ids, points = opened(asking)
        found = _Nearest(points, k)
        found.show(*opened(held))
        return found.frame(query_ids)

    keys = ["part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, _FOUND)
