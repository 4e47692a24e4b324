"""Command line: ``python -m riskweave <job> ...``; see ``--help``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from riskweave.plans import jobs, models, questions, scoring
from riskweave.plans.features import with_accounts
from riskweave.plans.staging import parse_payload
from riskweave.schemas import ALERTS_TOPIC, FAIRNESS_THRESHOLDS, MODEL_VERSION, PSI_RETRAIN, SEARCH_TRIALS
from riskweave.session import build_session, materialize
from riskweave.sinks.topics import publish
from riskweave.sinks.warehouse import Warehouse
from riskweave.sources.topics import json_lines, kafka_stream
from riskweave.streaming import features as streams
from riskweave.streaming import scoring as stream_scoring
from riskweave.streaming.intake import valid_only
from riskweave.streaming.runner import await_all, await_any


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="riskweave")
    root.add_argument("--warehouse", required=True, help="root folder of the warehouse")
    jobs_ = root.add_subparsers(dest="job", required=True)

    load = jobs_.add_parser("load", help="insert raw tables from Parquet")
    for name in ("transactions", "accounts", "merchants"):
        load.add_argument(f"--{name}", required=True)
    wide = jobs_.add_parser("load-wide", help="merge, encode and pack the wide files, insert new rows, and report the table")
    wide.add_argument("--transactions", required=True, help="CSV with a header")
    wide.add_argument("--identity", help="CSV with a header, joined by --key")
    wide.add_argument("--key", default="TransactionID")
    jobs_.add_parser("stage", help="clean raw transactions")

    score = jobs_.add_parser("score", help="score staged transactions")
    score.add_argument("--alerts", help="folder for the alert payload")
    score.add_argument("--model", help="bundle of a trained fraud model; without it the fixed linear model scores")
    score.add_argument("--credit-model", help="bundle of a trained credit model: fills credit_risk_score")
    score.add_argument("--anomaly-model", help="bundle of a trained anomaly model, a part of the credit score")

    ask = jobs_.add_parser("ask", help="ask the stored risk scores; prints one JSON line per row")
    ask.add_argument("question", choices=questions.QUESTIONS)
    ask.add_argument("--as-of", required=True)
    for name, kind in (("hours", int), ("hours-back", int), ("weeks", int), ("limit", int), ("min-score", float), ("max-score", float), ("decision", str)):
        ask.add_argument(f"--{name}", type=kind)

    drift = jobs_.add_parser("drift", help="drift report; exit code 1 on drift")
    drift.add_argument("--as-of", required=True)
    drift.add_argument("--threshold", type=float, default=PSI_RETRAIN)

    gate = jobs_.add_parser("fairness", help="fairness gate; exit code 1 when it fails")
    gate.add_argument("--as-of", required=True)
    gate.add_argument("--model", default="fraud_detector")
    gate.add_argument("--version", default="latest")
    gate.add_argument("--hitl", metavar="NAME", help="sign off a failed gate")
    for metric, value in FAIRNESS_THRESHOLDS.items():
        gate.add_argument(f"--threshold-{metric.removesuffix('_difference').replace('_', '-')}", type=float, default=value)

    train = jobs_.add_parser("train", help="train a model and save it")
    train.add_argument("model", choices=["fraud", "credit", "anomaly", "wide"])
    train.add_argument("--out", required=True, help="new folder for the bundle")
    train.add_argument("--trials", type=int, help="random search trials (fraud 30, credit 20); 0 fits without a search")
    train.add_argument("--sample", type=int, default=models.SAMPLE, help="rows that a fit and a trial may see")

    for name, text in (("stream-features", "window features from the topic"), ("stream-score", "scores, audit and alerts from the topic")):
        stream = jobs_.add_parser(name, help=text)
        source = stream.add_mutually_exclusive_group(required=True)
        source.add_argument("--bootstrap", help="broker of the topic")
        source.add_argument("--topic-files", help="folder of payloads, one JSON value per line, in place of a broker")
        stream.add_argument("--once", action="store_true", help="process what is available, then stop")
        if name == "stream-score":
            stream.add_argument("--every", default="5 seconds", help="time between batches")
            for option in ("--model", "--credit-model", "--anomaly-model"):
                stream.add_argument(option, help="bundle, as for score")
    return root


def _topic(spark, args):
    return kafka_stream(spark, args.bootstrap) if args.bootstrap else json_lines(spark, args.topic_files)


def _stream_score(spark, warehouse: Warehouse, args) -> None:
    """Score the topic; with a broker, alerts go to their topic besides."""
    scorer, version = _scorer(spark, args)
    accounts = warehouse.read("raw.accounts") if args.credit_model else None
    send = (lambda payload: publish(payload, args.bootstrap, ALERTS_TOPIC)) if args.bootstrap else None
    query = stream_scoring.start_scoring(
        spark,
        parse_payload(_topic(spark, args)),
        f"{args.warehouse}/mart/stream",
        f"{args.warehouse}/checkpoints",
        scorer if accounts is None else lambda batch: scorer(with_accounts(batch, accounts)),
        None if args.once else args.every,
        version,
        validate=True,
        send=send,
    )
    await_all([query]) if args.once else await_any(spark, [query])


def _scored(warehouse: Warehouse):
    txns = with_accounts(warehouse.read("staging.transactions"), warehouse.read("raw.accounts"))
    return scoring.linear_scores(txns)


def _train(warehouse: Warehouse, args) -> dict:
    """Fit, save the bundle, and return what its ``about`` says."""
    if args.model == "wide":
        trials = SEARCH_TRIALS["wide"] if args.trials is None else args.trials
        bundle = models.train_wide(warehouse.read("raw.wide_transactions"), trials=trials, sample=args.sample)
        models.save(bundle, args.out)
        return bundle.about
    txns = warehouse.read("staging.transactions")
    if args.model == "anomaly":
        bundle = models.train_forest(materialize(txns, "train"))
    else:
        if args.model == "credit":
            txns = _with_age(with_accounts(txns, warehouse.read("raw.accounts"), "inner"))
        trials = SEARCH_TRIALS[args.model] if args.trials is None else args.trials
        bundle = models.train(txns, args.model, trials=trials, sample=args.sample)
    models.save(bundle, args.out)
    return bundle.about


def _with_age(txns):
    return txns.withColumn("account_age_days", F.col("age_days"))


def _scorer(spark, args):
    """The scorer that the options ask for, and its version: bundles, or the fixed linear model."""
    if not args.model:
        if args.credit_model or args.anomaly_model:
            raise SystemExit("--credit-model and --anomaly-model need --model")
        return scoring.linear_scores, MODEL_VERSION
    fraud = models.load(spark, args.model)
    if not args.credit_model:
        return (lambda rows: models.fraud_scores(rows, fraud, explain=True)), fraud.version
    if not args.anomaly_model:
        raise SystemExit("a credit score is composed with an anomaly model: --anomaly-model")
    parts = models.load(spark, args.credit_model), models.load(spark, args.anomaly_model)
    return (lambda rows: models.with_credit(models.fraud_scores(_with_age(rows), fraud, explain=True), *parts)), fraud.version


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    warehouse = Warehouse(spark, args.warehouse)
    if args.job == "load":
        jobs.load(warehouse, *[spark.read.parquet(getattr(args, n)) for n in ("transactions", "accounts", "merchants")])
    elif args.job == "load-wide":
        read = lambda path: spark.read.csv(path, header=True, inferSchema=True)
        report = jobs.load_wide(warehouse, read(args.transactions), read(args.identity) if args.identity else None, args.key)
        print(json.dumps(report.first().asDict()))
    elif args.job == "stage":
        jobs.stage(warehouse).groupBy("failed_rules").count().show(truncate=False)
    elif args.job == "score":
        scorer, version = _scorer(spark, args)
        rows = warehouse.read("staging.transactions")
        if args.credit_model:
            rows = with_accounts(rows, warehouse.read("raw.accounts"))
        payload = jobs.score(warehouse, rows, F.col("created_at"), scorer, version)
        if args.alerts:
            payload.select("value").write.mode("append").text(args.alerts)
    elif args.job == "ask":
        names = ("hours", "hours_back", "weeks", "limit", "min_score", "max_score", "decision")
        options = {n: getattr(args, n) for n in names if getattr(args, n) is not None}
        for line in questions.ask(warehouse, args.question, args.as_of, **options).toJSON().toLocalIterator():
            print(line)
    elif args.job == "drift":
        report = jobs.monitor_drift(warehouse, args.as_of, args.threshold)
        report.show(truncate=False)
        return int(not report.filter("report_drift").isEmpty())
    elif args.job == "fairness":
        limits = {
            m: getattr(args, f"threshold_{m.removesuffix('_difference')}") for m in FAIRNESS_THRESHOLDS
        }
        row = jobs.fairness_gate(warehouse, _scored(warehouse), args.model, args.version, args.as_of, limits).first()
        print(json.dumps(row.asDict(), default=str))
        if not row["gate_passed"] and args.hitl:
            jobs.override_gate(warehouse, args.model, args.version, args.hitl, "signed off", args.as_of)
            return 0
        return int(not row["gate_passed"])
    elif args.job == "train":
        print(json.dumps(_train(warehouse, args)))
    elif args.job == "stream-features":
        stream = valid_only(streams.from_topic(_topic(spark, args)))
        mart = f"{args.warehouse}/mart"
        streams.run_features(spark, stream, mart, f"{args.warehouse}/checkpoints", continuous=not args.once)
    elif args.job == "stream-score":
        _stream_score(spark, warehouse, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
