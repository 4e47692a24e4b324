"""Adapter from the generic test tables to the warehouse shapes.

The only module that knows the test tables; every plan takes the shapes below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import base_rate, day_of_week, hour_of_day, spend_ratio
from riskweave.plans import features
from riskweave.plans.scoring import FIXED_MODEL, linear_scores, risk_scores
from riskweave.schemas import CATEGORIES
from riskweave.session import use_utc, widen

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{path}/{name}.parquet")


def category_of(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k % len(CATEGORIES)).cast("int") + 1)


def accounts(spark: SparkSession, path: str) -> DataFrame:
    customer, nation, region = (table(spark, path, n) for n in ("customer", "nation", "region"))
    # 25 nations: as a looked-up map they cost no join, and the size of the
    # result stays that of the customer files, which is what join planning uses
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).agg(
        F.map_from_entries(F.collect_list(F.struct("n_nationkey", "r_name")))
    )
    segment = F.col("c_mktsegment")
    return customer.withColumn("_region", F.try_element_at(places.scalar(), F.col("c_nationkey"))).select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.when(segment == "FURNITURE", "savings")
        .when(segment == "HOUSEHOLD", "credit")
        .when(segment == "MACHINERY", "business")
        .otherwise("checking")
        .alias("account_type"),
        (30 + (F.col("c_custkey") * 37) % 3620).cast("int").alias("age_days"),
        (F.lit(100.0) + F.abs("c_acctbal")).alias("avg_monthly_spend"),
        F.col("_region").alias("region"),
        (F.col("c_acctbal") < 0).alias("is_high_risk"),
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    return widen(table(spark, path, "documents"), "doc_id")


def merchants(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, path, "part").select(
        key.cast("string").alias("merchant_id"),
        category_of(key).alias("category"),
        base_rate(category_of(key)).alias("base_fraud_rate"),
        (key % 7 == 0).alias("is_foreign"),
        F.col("p_retailprice").alias("avg_txn_amount"),
    )


def base_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions before the account look-up and the velocity feature."""
    return events_as_transactions(table(spark, path, "events"))


def events_as_transactions(events: DataFrame) -> DataFrame:
    k = F.col("k")
    return (
        events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        .select(
            F.col("event_id").cast("string").alias("txn_id"),
            F.col("user_id").cast("string").alias("account_id"),
            k.cast("string").alias("merchant_id"),
            F.col("value").alias("amount"),
            category_of(k).alias("merchant_category"),
            (k % 7 == 0).alias("is_foreign_merchant"),
            hour_of_day(F.col("ts")).alias("hour_of_day"),
            day_of_week(F.col("ts")).alias("day_of_week"),
            (F.col("event_type") == "error").alias("is_fraud"),
            F.col("event_type").alias("channel"),
            F.col("ts").alias("created_at"),
        )
    )


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions with velocity and spend ratio, joined to their account."""
    timed = features.trailing_velocity(base_transactions(spark, path))
    return features.with_accounts(timed, accounts(spark, path)).withColumn(
        "amount_vs_avg_ratio", spend_ratio(F.col("amount"), F.col("avg_monthly_spend"))
    )


def scored(spark: SparkSession, path: str) -> DataFrame:
    return linear_scores(transactions(spark, path), FIXED_MODEL)


def risk_table(spark: SparkSession, path: str) -> DataFrame:
    return risk_scores(scored(spark, path), F.col("created_at"))


def replayed_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Base transactions with every tenth event delivered twice."""
    base = base_transactions(spark, path)
    copies = F.when(F.col("txn_id").cast("bigint") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("delivery", F.explode(copies))


def wide_left(spark: SparkSession, path: str) -> DataFrame:
    """Wide transaction file: ids, elapsed seconds, amount, flags, counts."""
    flag = F.col("l_returnflag")
    return widen(table(spark, path, "lineitem"), "l_orderkey").select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("int").cast("string"),
        ).alias("TransactionID"),
        F.col("l_orderkey").alias("OrderID"),
        (flag == "R").cast("int").alias("isFraud"),
        F.timestamp_diff("SECOND", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate")).alias(
            "TransactionDT"
        ),
        F.col("l_extendedprice").alias("TransactionAmt"),
        F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")).alias("ProductCD"),
        F.when(flag == "A", "credit").when(flag == "N", "debit").alias("card6"),
        F.col("l_suppkey").cast("double").alias("addr1"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("dist1"),
        F.when(F.col("l_linestatus") == "F", "gmail.com").otherwise("mail.com").alias("P_emaildomain"),
        F.col("l_quantity").alias("C1"),
        F.col("l_discount").alias("C2"),
        F.col("l_linenumber").cast("double").alias("D1"),
        F.when(flag == "A", "T").when(flag == "N", "F").alias("M1"),
        F.when(F.col("l_linestatus") == "O", "T").otherwise("F").alias("M2"),
    )


def wide_right(spark: SparkSession, path: str) -> DataFrame:
    """Identity file; orders still in progress have no identity record."""
    status = F.col("o_orderstatus")
    return (
        table(spark, path, "orders")
        .filter(status != "P")
        .select(
            F.col("o_orderkey").alias("OrderID"),
            F.when(status == "F", "gmail.com").otherwise("mail.com").alias("R_emaildomain"),
            F.col("o_orderpriority").alias("DeviceType"),
            F.col("o_totalprice").alias("id_01"),
        )
    )


def human_overrides(scored_rows: DataFrame) -> DataFrame:
    """Analyst overrides of flagged rows; foreign purchases are revisited."""
    at = F.col("created_at")
    first = F.struct(
        F.when(F.col("channel") == "purchase", "CLEAR").otherwise("FRAUD").alias("override_decision"),
        (at + F.expr("INTERVAL 1 HOUR")).alias("overridden_at"),
    )
    second = F.struct(F.lit("REVIEW").alias("override_decision"), (at + F.expr("INTERVAL 2 HOURS")).alias("overridden_at"))
    flagged = scored_rows.filter(
        F.col("decision").isin("FRAUD", "REVIEW") & F.col("channel").isin("purchase", "signup")
    )
    rows = F.when(F.col("is_foreign_merchant"), F.array(first, second)).otherwise(F.array(first))
    return flagged.select(
        "txn_id",
        F.col("decision").alias("original_decision"),
        F.explode(rows).alias("o"),
    ).select("txn_id", "original_decision", "o.*")
