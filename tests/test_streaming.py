"""Streams against their batch twins: late rows, repeats, restarts, redone epochs."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave import dataset
from riskweave.plans import features
from riskweave.plans.staging import to_payload
from riskweave.sinks.tables import KeyedLog, append, insert_new, write
from riskweave.sinks.topics import publish_files
from riskweave.sources.files import csv_wanted, parquet_if_exists, require_table, table_probe
from riskweave.sources.topics import json_lines, replay
from riskweave.streaming import features as streams
from riskweave.streaming import scoring
from riskweave.streaming.runner import await_all, start

T0 = datetime(2024, 1, 1, 10)
SCHEMA = "txn_id string, account_id string, merchant_id string, amount double, created_at timestamp, event_id string"


def rows(spark, *items):
    return spark.createDataFrame(
        [(t, "a", "m", float(x), T0 + timedelta(minutes=m), f"e{t}") for t, x, m in items], SCHEMA
    ).coalesce(1)


def add_file(df, path):
    df.write.mode("append").parquet(path)


def run(spark, source, out, tables=("features_account_txn_counts",), prepare=lambda s: s):
    stream = prepare(streams.timed(replay(spark, source, SCHEMA, files_per_trigger=1)))
    streams.run_features(spark, stream, out, f"{out}/checkpoints", list(tables))
    return {t: streams.feature_table(spark, out, t) for t in tables}


def test_updates_replace_and_late_rows_drop(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for batch in ([("1", 10, 0)], [("2", 20, 30), ("3", 5, 180)], [("5", 1, 181)], [("4", 99, 5)]):
        add_file(rows(spark, *batch), source)
        time.sleep(1.1)  # files are taken in order of their time stamp
    table = run(spark, source, out)["features_account_txn_counts"]
    got = {r["window_start"].hour: (r["txn_count_1h"], r["total_amount_1h"]) for r in table.collect()}
    # row 4 comes two batches after the watermark passed its window
    assert got == {10: (2, 30.0), 13: (2, 6.0)}
    # a restart with the same checkpoint and one more file only adds its rows
    add_file(rows(spark, ("6", 4, 182)), source)
    table = run(spark, source, out)["features_account_txn_counts"]
    got = {r["window_start"].hour: (r["txn_count_1h"], r["total_amount_1h"]) for r in table.collect()}
    assert got == {10: (2, 30.0), 13: (3, 10.0)}


def test_all_four_features_match_batch(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    data = rows(spark, *[(str(i), i + 1, 7 * i % 300) for i in range(60)])
    add_file(data, source)
    tables = run(spark, source, out, tuple(features.STREAM_FEATURES))
    for name, plan in features.STREAM_FEATURES.items():
        batch = plan(data)
        assert tables[name].count() == batch.count() > 0
        assert tables[name].select(batch.columns).exceptAll(batch).isEmpty()


def test_repeated_events_count_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    add_file(rows(spark, ("1", 10, 0)), source)
    add_file(rows(spark, ("1", 10, 0), ("2", 5, 1)), source)
    table = run(spark, source, out, prepare=streams.deduplicated)["features_account_txn_counts"]
    assert [r["txn_count_1h"] for r in table.collect()] == [2]


def test_json_topic_end_to_end(spark, tmp_path):
    sent = rows(spark, *[(str(i), 100 + 10 * i, i) for i in range(20)])
    publish_files(to_payload(sent), f"{tmp_path}/topic")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{tmp_path}/topic")
    stream = streams.from_topic(json_lines(spark, f"{tmp_path}/topic"))
    streams.run_features(spark, stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["features_account_txn_counts"])
    table = streams.feature_table(spark, f"{tmp_path}/out", "features_account_txn_counts").filter("account_id is not null")
    assert [(r["txn_count_1h"], r["total_amount_1h"]) for r in table.collect()] == [(20, 3900.0)]


def test_scoring_outputs(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    add_file(rows(spark, ("1", 500, 0), ("2", 5, 1)), source)
    stream = replay(spark, source, SCHEMA)
    await_all([scoring.start_scoring(spark, stream, out, f"{out}/ck")])
    scores = {r["txn_id"]: r["decision"] for r in scoring.score_table(spark, out).collect()}
    assert scores == {"1": "FRAUD", "2": "CLEAR"}
    assert spark.read.parquet(f"{out}/model_decisions").count() == 2
    assert '"txn_id":"1"' in spark.read.text(f"{out}/alerts").first()["value"]


def test_failing_query_is_reported(spark, tmp_path):
    source = f"{tmp_path}/in"
    add_file(rows(spark, ("1", 1, 0)), source)

    def broken(batch):
        raise RuntimeError("no scorer")

    query = scoring.start_scoring(spark, replay(spark, source, SCHEMA), f"{tmp_path}/o", f"{tmp_path}/c", broken)
    with pytest.raises(Exception, match="no scorer"):
        await_all([query])


def test_keyed_log_redo_and_compaction(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", ["k"])
    assert log.current() is None

    def batch(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def table():
        return {r["k"]: r["v"] for r in log.current().collect()}

    log.write_epoch(batch(("a", 1), ("b", 1)), 0)
    log.write_epoch(batch(("a", 2)), 1)
    log.write_epoch(batch(("a", 2)), 1)  # the same epoch again
    log.write_epoch(batch(), 2)
    assert table() == {"a": 2, "b": 1}
    log.compact()
    assert table() == {"a": 2, "b": 1}
    log.write_epoch(batch(("b", 3), ("c", 3)), 10)
    assert table() == {"a": 2, "b": 3, "c": 3}
    log.compact()
    assert table() == {"a": 2, "b": 3, "c": 3}


def test_insert_keeps_the_first_write(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 0)], "k string, v int, seq int")
    second = spark.createDataFrame([("a", 9, 0), ("c", 9, 0)], "k string, v int, seq int")
    for batch in (first, first, second):
        insert_new(spark, batch, path, ["k"], [F.col("seq")])
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 1, "c": 9}
    assert spark.read.parquet(path).count() == 3


def test_append_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    append(df, f"{tmp_path}/a")
    append(df, f"{tmp_path}/a")
    write(df, f"{tmp_path}/w", ["k"])
    write(df, f"{tmp_path}/w", ["k"])
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    assert spark.read.parquet(f"{tmp_path}/w").count() == 1
    assert parquet_if_exists(spark, f"{tmp_path}/none") is None


def test_csv_reads_only_wanted_columns(spark, tmp_path):
    spark.createDataFrame([("1", 2.5, "x")], "id string, amt double, other string").write.csv(f"{tmp_path}/c", header=True)
    got = csv_wanted(spark, f"{tmp_path}/c", {"amt": "double", "gone": "int", "id": "int"})
    assert got.dtypes == [("amt", "double"), ("id", "int")] and tuple(got.first()) == (2.5, 1)


def test_probes(spark):
    df = spark.createDataFrame([("a",)], "k string")
    row = table_probe(df, "t", ["k", "gone"]).first()
    assert (row["n_rows"], row["n_missing_columns"], row["has_rows"]) == (1, 1, True)
    with pytest.raises(LookupError):
        require_table(spark, "no_such_table")


def test_first_write_wins_over_epochs(spark, tmp_path):
    from pyspark.sql import functions as F
    from riskweave.sinks.tables import KeyedLog

    log = KeyedLog(spark, str(tmp_path / "log"), ["txn_id"], first=[F.col("score")])
    schema = "txn_id string, score double"
    log.write_epoch(spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 1.0)], schema), 0)
    log.write_epoch(spark.createDataFrame([("a", 3.0), ("c", 2.0)], schema), 1)
    log.compact()
    log.write_epoch(spark.createDataFrame([("c", 1.0), ("d", 4.0)], schema), 2)
    assert {r["txn_id"]: r["score"] for r in log.current().collect()} == {"a": 5.0, "b": 1.0, "c": 2.0, "d": 4.0}


def test_keyed_log_stays_readable(spark, tmp_path):
    """Many epochs, some of them empty or redone, some redone where a merge was due: the newest rows, in few folders."""
    for fanout, day in ((3, None), (2, F.col("at"))):
        log = KeyedLog(spark, f"{tmp_path}/log{fanout}", ["k"], day=day, fanout=fanout)
        log.GROUP = 4
        want = {}
        for epoch in range(14):
            batch = [] if epoch == 5 else [(f"k{epoch % 4}", epoch, T0 + timedelta(days=epoch % 4)), ("z", epoch, T0)]
            rows_ = spark.createDataFrame(batch, "k string, v int, at timestamp").coalesce(1)
            for _ in range(2 if epoch in (2, 3, 8) else 1):
                log.write_epoch(rows_, epoch)
            want |= {k: v for k, v, _ in batch}
        assert {r["k"]: r["v"] for r in log.current().collect()} == want
        assert log.current().columns == ["k", "v", "at"]
        levels = [p.level for p in log.parts()]
        assert max(levels) >= 2 and all(levels.count(level) < fanout for level in levels)
        # a reader that comes while an epoch is being written sees the table before it
        log._write(spark.createDataFrame([("new", 1, T0)], "k string, v int, at timestamp").withColumns({"_epoch": F.lit(14), "_day": F.to_date("at")}), type(log.parts()[0])("epochs/3/14", 0))
        assert "new" not in {r["k"] for r in log.current().collect()}


def test_keyed_log_reads_only_its_days(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", ["k", "at"], day=F.col("at"))
    for epoch in range(3):
        log.write_epoch(spark.createDataFrame([("a", epoch, T0 + timedelta(days=d)) for d in range(4)], "k string, v int, at timestamp"), epoch)
    recent = log.current(since=F.lit(T0 + timedelta(days=2)), until=F.lit(T0 + timedelta(days=2)))
    assert [(r["v"], r["at"]) for r in recent.collect()] == [(2, T0 + timedelta(days=2))]
    assert "PartitionFilters: [isnotnull(_day" in recent._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        KeyedLog(spark, f"{tmp_path}/other", ["k"]).write_epoch(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
        KeyedLog(spark, f"{tmp_path}/other", ["k"]).current(since=F.lit(T0))


def test_folders_of_a_thousand_epochs():
    """What a reader opens, and how often rows are rewritten, grow with the logarithm of the epochs."""
    from riskweave.sinks.tables import Part, merge_due

    parts, rewritten = [], 0
    for epoch in range(1000):
        parts.append(Part(f"epochs/{epoch}", 0))
        while due := merge_due(parts, 8):
            rewritten += sum(8**p.level for p in due)
            parts = [p for p in parts if p not in due] + [Part(f"merged/{epoch}-{due[0].level + 1}", due[0].level + 1)]
        assert len(parts) <= 7 * 4
    assert rewritten <= 3 * 1000


def test_intake_splits_every_batch(spark, tmp_path):
    """Bad amounts, missing accounts, repeats across files and a redone epoch: each row once, in one of two tables of the same epochs."""
    from riskweave.streaming import intake

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = rows(spark, ("1", 10, 0), ("2", -5, 1), ("3", 200000, 2))
    second = rows(spark, ("1", 10, 0), ("2", -5, 1), ("4", 7, 3)).withColumn("account_id", F.when(F.col("txn_id") != "4", F.col("account_id")))
    for batch in (first, second):
        add_file(batch, source)
        time.sleep(1.1)
    await_all([intake.start_intake(spark, replay(spark, source, SCHEMA, files_per_trigger=1), out, f"{out}/ck")])
    valid, rejected = intake.valid_log(spark, out), intake.rejected_log(spark, out)

    def tables():
        bad = {r["txn_id"]: r["failed_rules"] for r in rejected.current().collect()}
        return sorted(r["txn_id"] for r in valid.current().collect()), bad

    want = (["1"], {"2": ["amount_range"], "3": ["amount_range"], "4": ["account_id_present"]})
    assert tables() == want and len(valid.parts()) == len(rejected.parts()) == 2
    valid.write_epoch(second.filter("txn_id = '1'"), 1)  # the second epoch again
    assert tables() == want
    assert intake.valid_only(first).count() == 1


def test_stream_commands(spark, tmp_path):
    """The topic's files through both commands, twice: broken payloads are set aside, repeats change nothing."""
    from riskweave.__main__ import main

    topic, house = f"{tmp_path}/topic", f"{tmp_path}/house"
    publish_files(to_payload(rows(spark, ("1", 500, 0), ("2", 5, 1), ("3", -4, 2))), topic)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(topic)
    for _ in range(2):
        assert main(["--warehouse", house, "stream-score", "--topic-files", topic, "--once"]) == 0
        publish_files(to_payload(rows(spark, ("2", 900, 9), ("4", 600, 5))), topic)
    scores = {r["txn_id"]: r["decision"] for r in scoring.score_table(spark, f"{house}/mart/stream").collect()}
    assert scores == {"1": "FRAUD", "2": "CLEAR", "4": "FRAUD"}
    from riskweave.streaming.intake import rejected_log

    bad = {r["txn_id"]: set(r["failed_rules"]) for r in rejected_log(spark, f"{house}/mart/stream").current().collect()}
    assert bad["3"] == {"amount_range"} and "txn_id_present" in bad[None]
    alerts = [r["value"] for r in spark.read.text(f"{house}/mart/stream/alerts").collect()]
    assert sorted('"txn_id":"1"' in a for a in alerts)[-1] and len(alerts) >= 2
    assert main(["--warehouse", house, "stream-features", "--topic-files", topic, "--once"]) == 0
    table = streams.feature_table(spark, f"{house}/mart", "features_account_txn_counts")
    assert sum(r["txn_count_1h"] for r in table.collect()) >= 3


def test_one_folder_of_unique_keys_is_read_as_it_stands(spark, tmp_path):
    """No shuffle and sort where an epoch cannot hold a key twice; with a second folder, or without that knowledge, the newest row per key."""
    def log(name, unique):
        return KeyedLog(spark, f"{tmp_path}/{name}", ["k"], unique=unique)

    for name, unique in (("known", True), ("unknown", False)):
        log(name, unique).write_epoch(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), 0)
        plan = log(name, unique).current()._jdf.queryExecution().optimizedPlan().toString()
        assert ("row_number" in plan) is not unique
        log(name, unique).write_epoch(spark.createDataFrame([("a", 3)], "k string, v int"), 1)
        assert {(r["k"], r["v"]) for r in log(name, unique).current().collect()} == {("a", 3), ("b", 2)}
        log(name, unique).compact()
        assert "row_number" not in log(name, unique).current()._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["k"], r["v"]) for r in log(name, unique).current().collect()} == {("a", 3), ("b", 2)}


def test_feature_batches_are_not_kept(spark, sf_dir, tmp_path):
    """A batch goes to its folder in one pass; an epoch without rows adds no folder."""
    schema = dataset.table(spark, sf_dir, "events").schema
    stream = streams.timed(dataset.events_as_transactions(replay(spark, sf_dir, schema, glob="events.parquet")))
    kept = []
    batch = stream.groupBy("account_id").count()
    query = start(batch, "once", lambda rows, epoch: kept.append((rows.storageLevel.useMemory, rows.count() > 0)), f"{tmp_path}/once", once=True)
    query.awaitTermination()
    assert kept and not any(memory for memory, _ in kept)
    streams.run_features(spark, stream, str(tmp_path), f"{tmp_path}/checkpoints", ["features_velocity"])
    assert len(streams.feature_log(spark, str(tmp_path), "features_velocity").parts()) == 1
