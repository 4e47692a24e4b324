"""Metrics, encoding, forest, neighbours, chunks and the wide load."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import forest as forests
from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.operators.keyed import small_or_same, top_per_key
from riskweave.operators.knn import _by_cells, _by_tiles, nearest
from riskweave.operators.ordering import sorted_codes
from riskweave.plans import metrics, retrieval, staging, training, wide


def ranked_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 6])
def test_binary_metrics_with_ties(spark, digits):
    rng = random.Random(digits)
    pairs = [(round(rng.random() ** 6, digits), rng.random() < 0.3) for _ in range(400)]
    row = metrics.binary_metrics(spark.createDataFrame(pairs, "s double, y boolean"), "s", "y").first()
    assert row["roc_auc"] == pytest.approx(ranked_auc(pairs))
    total = sum(y for _, y in pairs)
    seen, hits, ap = 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        here = [y for t, y in pairs if t == s]
        seen, hits = seen + len(here), hits + sum(here)
        ap += sum(here) / total * hits / seen
    assert row["average_precision"] == pytest.approx(ap)


def test_metrics_without_positives(spark):
    row = metrics.binary_metrics(spark.createDataFrame([(0.2, False), (0.9, False)], "s double, y boolean"), "s", "y").first()
    assert row["roc_auc"] is None and row["f1"] == 0.0


def test_codes_follow_sorted_order(spark):
    words = sorted({"".join(random.Random(i).choices("abc", k=4)) for i in range(200)} | {"", "é", "ab"})
    df = spark.createDataFrame([(w,) for w in words * 3], "w string")
    got = {r["w"]: r["code"] for r in sorted_codes(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_unseen_and_null_labels(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = fit_codes(fit, ["c"])
    new = spark.createDataFrame([("a",), ("b",), (None,), ("zzz",)], "c string")
    got = [r["c_code"] for r in apply_codes(new, codes, ["c"], suffix="_code").collect()]
    # "__NAN__" sorts before letters
    assert sorted(got) == [0, 0, 1, 2]


def test_small_side_is_broadcast_only_when_small(spark):
    df = spark.range(100).groupBy("id").count()
    joined = spark.range(10**6).join(small_or_same(df, 100).filter("count > 0"), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert small_or_same(df, 99) is df


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    out = top_per_key(df, ["k"], [F.desc("id")], 3)
    assert sorted(r["id"] for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_split_keeps_label_shares(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("txn_id"), (F.col("id") % 8 == 0).alias("y"))
    from riskweave.functions.scalars import uniform01

    split = staging.split_by_hash(df, uniform01(F.concat_ws("|", F.col("y").cast("string"), "txn_id")))
    shares = {r["split"]: (r["n"], r["rate"]) for r in split.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("int")).alias("rate")).collect()}
    assert abs(shares["test"][0] / 20000 - 0.15) < 0.01 and abs(shares["validation"][0] / 20000 - 0.1275) < 0.01
    assert all(abs(rate - 0.125) < 0.02 for _, rate in shares.values())
    assert staging.train_and_validation(split).count() == 20000 - shares["test"][0]


def planted(spark, n=3000):
    rng = np.random.default_rng(0)
    points = rng.normal(0, 1, (n, 2))
    points[:30] = rng.normal(9, 0.5, (30, 2))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, a double, b double")


def test_forest_finds_planted_outliers(spark):
    df = planted(spark)
    model = forests.fit_forest(df, "id", ["a", "b"], trees=50, sample=128, contamination=0.02)
    assert model.nodes["feature"].shape[0] == 50 and model.nodes["feature"].shape[1] <= 2 * 128 - 1
    scored = forests.forest_scores(df, model)
    flagged = [r["id"] for r in scored.filter(F.col("anomaly_raw") < model.offset).select("id").collect()]
    assert len(flagged) <= 0.025 * 3000 and len([i for i in flagged if i < 30]) >= 28
    again = forests.fit_forest(df, "id", ["a", "b"], trees=50, sample=128, contamination=0.02)
    assert again.offset == model.offset


def test_forest_samples_stay_bounded(spark):
    df = spark.range(50000).withColumn("x", F.rand(1))
    for rows, trees in ((50000, 10), (400, 20)):
        drawn = forests.draw_samples(df.limit(rows), "id", rows, trees, 64)
        sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
        assert len(sizes) == trees and max(sizes) == 64 and min(sizes) >= 40


def test_forest_samples_follow_one_rule(spark):
    def drawn(rows):
        return {(r["tree"], r["id"]) for r in forests.draw_samples(spark.range(2600), "id", rows, 10, 64).select("tree", "id").collect()}

    below, above = drawn(2560), drawn(2561)  # 4 * trees * sample, and one more
    assert len(below & above) > 0.95 * len(below)
    assert len({i for _, i in above}) < len(above)  # trees share rows at any size


def test_average_path():
    assert forests.average_path(1) == 0 and forests.average_path(2) == 1
    assert forests.average_path(256) == pytest.approx(10.244, abs=1e-3)


def vectors(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    points = np.vstack([rng.normal(c, 1, (n // 4, 8)) for c in (0, 0, 3, 6)])
    points = np.vstack([points, np.repeat(points[:1], copies, axis=0)])
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")


def brute(queries, points, k):
    out = set()
    for q, v in enumerate(queries):
        d = np.round(((points - v) ** 2).sum(axis=1), 9)
        out |= {(q, i) for i in sorted(range(len(d)), key=lambda i: (d[i], i))[:k]}
    return out


@pytest.mark.parametrize("budget", [10**6, 0])
def test_nearest_is_exact_on_both_paths(spark, budget):
    points, corpus = vectors(spark, 200, 1, copies=100)
    asked, queries = vectors(spark, 60, 2)
    got = {(r["query_id"], r["corpus_id"]) for r in nearest(queries, corpus, 3, broadcast_values=budget).collect()}
    assert got == brute(asked, points, 3)


def test_hot_cell_is_cut_into_blocks(spark):
    points, corpus = vectors(spark, 120, 3, copies=400)
    found = _by_cells(corpus.limit(50), corpus, 3, pivots=8, block_rows=40)
    top = top_per_key(found, ["query_id"], [F.col("distance"), F.col("corpus_id")], 3)
    assert {(r["query_id"], r["corpus_id"]) for r in top.collect()} == brute(points[:50], points, 3)


def test_tiles_meet_once_each(spark):
    """Vectors that cells cannot rule out: packed tiles, each pair of tiles in one group, and no row per cell."""
    points, corpus = vectors(spark, 3000, 4, copies=200)
    found = _by_tiles(corpus.filter("id % 3 = 0"), corpus, 3, len(points), tile_values=4000)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * -(-len(points) * 8 // 4000)
    top = top_per_key(found, ["query_id"], [F.col("distance"), F.col("corpus_id")], 3)
    want = {(3 * q, i) for q, i in brute(points[::3], points, 3)}
    assert {(r["query_id"], r["corpus_id"]) for r in top.collect()} == want
    wide = np.random.default_rng(6).normal(size=(400, 40))
    even = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(wide)], "id long, vector array<double>")
    assert "points" in nearest(even, even, 3, broadcast_values=0)._jdf.queryExecution().toString()  # tiles are chosen
    got = {(r["query_id"], r["corpus_id"]) for r in nearest(even, even, 3, broadcast_values=0).collect()}
    assert got == brute(wide, wide, 3)


def test_fewer_vectors_than_asked(spark):
    _, corpus = vectors(spark, 4, 5)
    for budget in (10**6, 0):
        got = nearest(corpus.limit(2), corpus.limit(2), 3, broadcast_values=budget)
        assert got.count() == 4


def test_chunks_follow_borders():
    text = "\n\n".join(["word " * 60, "x" * 1200, "short line\nnext line"])
    chunks = retrieval.split_text(text)
    assert all(0 < len(c) <= 500 for c in chunks)
    assert "".join(chunks).count("x") >= 1200 and chunks[-1].endswith("next line")
    assert retrieval.split_text("") == [] and retrieval.split_text("  \n ") == []
    assert retrieval.split_text("one two") == ["one two"]


def test_chunks_overlap_by_words():
    words = [f"w{i:04d}" for i in range(400)]
    chunks = retrieval.split_text(" ".join(words))
    for left, right in zip(chunks, chunks[1:]):
        shared = set(left.split()) & set(right.split())
        assert 1 <= len(shared) and len(" ".join(sorted(shared))) <= 50
    assert [w for c in chunks for w in c.split() if True and w] and set(" ".join(chunks).split()) == set(words)


def test_gbt_learns_and_search_reports(spark):
    from pyspark.ml.regression import GBTRegressor

    rng = random.Random(3)
    rows = [(str(i), rng.uniform(0, 200), rng.choice(["grocery", "gambling"])) for i in range(600)]
    df = spark.createDataFrame(rows, "txn_id string, amount double, merchant_category string")
    df = df.withColumn("is_fraud", (F.col("amount") > 120) & (F.col("merchant_category") == "gambling"))
    prepared = training.prepare_fraud(df)
    model = training.fit_fraud(prepared, maxIter=5)
    row = metrics.binary_metrics(training.score_fraud(prepared, model), "raw_probability", "is_fraud").first()
    assert row["roc_auc"] > 0.98
    credit = training.prepare_credit(df, F.col("amount") / 200)
    found = training.search(credit, GBTRegressor(), {"maxIter": [2, 3], "maxDepth": [2]}, 2, regression=True)
    assert len(found.validationMetrics) == 2


def test_wide_load(spark):
    left = spark.createDataFrame(
        [(1, 0, 3600 * 25, 10.0, "a.com", "credit", "T", 5.0, 1.0), (2, 1, 86400 * 8, 20.0, None, None, None, None, 1.0)],
        "TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, P_emaildomain string, card6 string, M1 string, addr1 double, V1 double",
    )
    right = spark.createDataFrame([(1, "a.com", 7.5)], "TransactionID long, R_emaildomain string, id_01 double")
    rows = wide.engineer(wide.merge(left, right)).orderBy("TransactionID").collect()
    assert [(r["hour_of_day"], r["day_of_week"], r["email_match"], r["is_credit"], r["M1"]) for r in rows] == [
        (1, 1, 1, 1, 1), (0, 1, 0, 0, -1),
    ]
    clean = wide.fill_sentinel(wide.encode_text(wide.engineer(wide.merge(left, right))))
    pruned = wide.drop_near_constant(clean)
    assert "V1" not in pruned.columns and "id_01" in pruned.columns
    packed = wide.pack(pruned).orderBy("TransactionID").collect()
    assert packed[1]["addr1"] is None and '"id_01":null' in packed[1]["features_json"]
    opened = wide.unpack(wide.pack(pruned), ["id_01", "gone"]).orderBy("TransactionID").collect()
    assert [(r["id_01"], r["gone"]) for r in opened] == [(7.5, -999.0), (-999.0, -999.0)]
    assert wide.merge(left, None) is left
    check = wide.load_check(left).first()
    assert (check["total"], check["fraud_count"], check["fraud_rate"]) == (2, 1, 0.5)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_codes_of_large_vocabularies(spark):
    """Three columns of 30,000 values: no row is moved for a lookup, and codes follow the sorted order of each column."""
    df = spark.range(90_000).select(*[F.concat(F.lit(p), F.format_string("%05d", (F.col("id") * m) % 30_000)).alias(p) for p, m in (("a", 1), ("b", 7), ("c", 11))])
    codes = fit_codes(df, ["a", "b", "c"])
    assert exchanges(codes) <= 3  # of totals per range and per column; the values are written with their ranges
    coded = apply_codes(df, codes, ["a", "b", "c"], suffix="_code")
    assert exchanges(coded) == 0
    wrong = [F.col(f"{c}_code") != F.substring(c, 2, 5).cast("int") for c in "abc"]
    assert coded.filter(wrong[0] | wrong[1] | wrong[2]).isEmpty()
    shuffled = apply_codes(df, codes, ["a", "b"], suffix="_code", most=100)
    assert exchanges(shuffled) >= 2 and shuffled.filter(wrong[0] | wrong[1]).isEmpty()


def test_ranges_stay_even(spark):
    """No range holds much more than its share, whatever the values share: a long prefix, or all but the last digits."""
    from riskweave.operators.ordering import ranged, running_totals

    crowded = spark.range(20_000).select((F.lit(0.5) + F.col("id") * 1e-11).alias("s"), F.lit(1).alias("one"))
    same_prefix = spark.range(20_000).select(F.format_string("the same long prefix %06d", F.col("id")).alias("s"))
    for df in (crowded, same_prefix):
        sizes = [r["count"] for r in ranged(df, [F.col("s")], 10).groupBy("_range").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 0.2 * 20_000
    got = running_totals(crowded, F.col("s"), ["one"], descending=True, ranges=7)
    assert got.filter(F.round((F.lit(0.5) + 20_000 * 1e-11 - F.col("s")) / 1e-11) != F.col("cum_one")).isEmpty()
    assert running_totals(crowded.limit(0), F.col("s"), ["one"]).count() == 0


def test_metrics_of_crowded_scores(spark):
    """All scores within 1e-6 of each other."""
    rng = random.Random(4)
    pairs = [(0.25 + rng.randrange(500) * 2e-9, rng.random() < 0.4) for _ in range(600)]
    row = metrics.binary_metrics(spark.createDataFrame(pairs, "s double, y boolean"), "s", "y").first()
    assert row["roc_auc"] == pytest.approx(ranked_auc(pairs)) and row["n_rows"] == 600


def test_chunks_of_a_batch_leave_in_small_parts(spark):
    """All chunks of every text in order, whatever the part of the batch, with the other columns as they are."""
    texts = [("word%d " % i) * (i * 7) if i % 5 else None for i in range(200)]
    docs = spark.createDataFrame([(i if i % 9 else None, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, more array<int>").coalesce(1)
    out = retrieval.chunk_recursive(docs)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    want = [(i if i % 9 else None, [i], n, c) for i, t in enumerate(texts) if t for n, c in enumerate(retrieval.split_text(t))]
    assert [tuple(r) for r in out.collect()] == want
