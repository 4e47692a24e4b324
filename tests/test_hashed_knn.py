"""Hashed neighbours against brute force: recall, copies in one bucket, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import hashed_knn
from riskweave.operators.knn import nearest


def clusters(spark, n, seed=1, copies=0, width=16):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width)) + 3 * rng.normal(size=(n // 20, width))[rng.integers(0, n // 20, n)]
    points = np.vstack([points, np.repeat(points[:1], copies, axis=0)])
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").repartition(4)


def test_recall_and_exact_distances(spark):
    points, df = clusters(spark, 2000)
    made, share = hashed_knn.fitted(df, 4, goal=0.95)
    assert share >= 0.95 and made.planes.shape[1] >= 4  # there are buckets to choose from
    rows = hashed_knn.nearest_hashed(df, df, made, 4).collect()
    squares = (points**2).sum(axis=1)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["position"], r["corpus_id"], r["distance"]))
    hits = 0
    for q, near in found.items():
        d = np.round(np.maximum(squares + squares[q] - 2 * points @ points[q], 0), 9)
        near.sort()
        assert [p for p, _, _ in near] == list(range(1, len(near) + 1)) and near[0][1] == q
        assert all(x == pytest.approx(d[i], abs=1e-6) for _, i, x in near) and [x for *_, x in near] == sorted(x for *_, x in near)
        hits += len({i for _, i, _ in near} & set(np.lexsort((np.arange(len(d)), d))[:4].tolist()))
    assert len(found) == 2000 and hits >= 0.9 * 4 * 2000
    measured = hashed_knn.recall(hashed_knn.nearest_hashed(df, df, made, 4), nearest(df, df, 4)).first()
    assert measured["recall"] == pytest.approx(hits / 8000, abs=0.01) and measured["n_queries"] == 2000


def test_bucket_of_copies_is_cut(spark):
    """Many copies in one bucket: blocks of bounded size, and the same neighbours as from one block."""
    _, df = clusters(spark, 300, copies=900)
    made = hashed_knn.tables_for(df, 2, bucket_rows=100)
    asked = df.filter("id < 60")
    whole = hashed_knn.nearest_hashed(asked, df, made, 3)
    parts = hashed_knn.nearest_hashed(asked, df, made, 3, block_rows=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_few_vectors_and_none(spark):
    _, df = clusters(spark, 40)
    made = hashed_knn.tables_for(df, 3)
    assert made.planes.shape[1] == 0  # one bucket holds them all, so the result is exact
    got, want = (sorted(map(tuple, f.collect())) for f in (hashed_knn.nearest_hashed(df, df, made, 3), nearest(df, df, 3)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    none = df.filter("false")
    assert hashed_knn.fitted(none)[0] is None and hashed_knn.nearest_hashed(df, none, None, 3).count() == 0
    some = df.withColumn("vector", F.when(F.col("id") % 2 == 0, F.col("vector")))
    assert {r["corpus_id"] % 2 for r in hashed_knn.nearest_hashed(df, some, made, 3).collect()} == {0}


def test_goal_is_reached_without_clusters(spark):
    """Vectors without clusters: one copy of each is held, and enough buckets are looked into."""
    points = np.random.default_rng(3).normal(size=(1500, 48))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    made, share = hashed_knn.fitted(df, 4, goal=0.95)
    assert share >= 0.95 and made.planes.shape[0] == 1 and hashed_knn._placed(df, made, 1).count() == 1500
    asked = df.filter("id % 10 = 0")
    assert hashed_knn.recall(hashed_knn.nearest_hashed(asked, df, made, 4), nearest(asked, df, 4)).first()["recall"] >= 0.9
