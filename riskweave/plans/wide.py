"""Wide-table load: merge, engineer, encode, prune, pack. One job, no row loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.scalars import (
    elapsed_day,
    elapsed_hour,
    equal_flag,
    null_if_sentinel,
    sentinel_if_null,
    tf_flag,
)
from riskweave.operators.encode import apply_codes, fit_codes
from riskweave.schemas import SENTINEL

# columns kept as such in the table; all others go into the JSON blob
DEDICATED = [
    "TransactionID",
    "isFraud",
    "TransactionDT",
    "TransactionAmt",
    "ProductCD",
    "card4",
    "card6",
    "addr1",
    "addr2",
    "dist1",
    "P_emaildomain",
    "R_emaildomain",
    "hour_of_day",
    "day_of_week",
    "log_amount",
    "email_match",
    "is_credit",
]
MATCH_FLAGS = [f"M{i}" for i in range(1, 10)]
ID_COLUMNS = ["TransactionID", "isFraud"]
NUMERIC = (T.NumericType,)


def merge(transactions: DataFrame, identity: DataFrame | None, key: str = "TransactionID") -> DataFrame:
    """Left join of the identity file; without one the transactions alone."""
    return transactions if identity is None else transactions.join(identity, key, "left")


def engineer(df: DataFrame) -> DataFrame:
    """Derived columns; each needs its source columns and is skipped otherwise."""
    c, have = F.col, set(df.columns)
    new = {
        "hour_of_day": elapsed_hour(c("TransactionDT")),
        "day_of_week": elapsed_day(c("TransactionDT")),
        "log_amount": F.log1p(c("TransactionAmt")),
    }
    if {"P_emaildomain", "R_emaildomain"} <= have:
        new["email_match"] = equal_flag(c("P_emaildomain"), c("R_emaildomain"))
        new["purchaser_gmail"] = equal_flag(c("P_emaildomain"), F.lit("gmail.com"))
    if "card6" in have:
        new["is_credit"] = equal_flag(c("card6"), F.lit("credit"))
        new["is_debit"] = equal_flag(c("card6"), F.lit("debit"))
    for flag in MATCH_FLAGS:
        if flag in have:
            new[flag] = tf_flag(c(flag))
    return df.withColumns(new)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ID_COLUMNS]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in ID_COLUMNS]


def encode_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = text_columns(df) if columns is None else columns
    return apply_codes(df, fit_codes(df, columns), columns) if columns else df


def fill_sentinel(df: DataFrame) -> DataFrame:
    """Nulls of numeric columns become the sentinel (model boundary only)."""
    return df.na.fill(SENTINEL, subset=numeric_columns(df))


def variances(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.001) -> DataFrame:
    """(column, variance, keep) for all numeric columns from one aggregate."""
    columns = numeric_columns(df) if columns is None else columns
    one = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])
    return one.select(F.inline(rows)).withColumn("keep", ~F.coalesce(F.col("variance") < threshold, F.lit(False)))


def drop_near_constant(df: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Drop columns of negligible variance.

    The schema depends on the data, so the (one row per column) report is
    fetched before the plan continues.
    """
    weak = [r["column"] for r in variances(df, threshold=threshold).filter("NOT keep").collect()]
    return df.drop(*weak)


def pack(df: DataFrame) -> DataFrame:
    """Dedicated columns plus ``features_json`` with all others as numbers.

    The sentinel becomes null again, both in the blob and in the address and
    distance columns.
    """
    kept = [c for c in DEDICATED if c in df.columns]
    blob = [c for c in df.columns if c not in DEDICATED]
    nullable = {"addr1", "addr2", "dist1"}
    columns = [null_if_sentinel(F.col(c).cast("double")).alias(c) if c in nullable else F.col(c) for c in kept]
    body = F.struct(*[null_if_sentinel(F.col(c).cast("double")).alias(c) for c in blob])
    return df.select(*columns, F.to_json(body, {"ignoreNullFields": "false"}).alias("features_json"))


def unpack(packed: DataFrame, features: list[str], fill: bool = True) -> DataFrame:
    """Blob keys back to columns; missing values become the sentinel if asked."""
    if not features:
        return packed.drop("features_json")
    # named fields are parsed once a row and found by their place; a map is searched for each
    blob = F.from_json("features_json", T.StructType([T.StructField(f, T.DoubleType()) for f in dict.fromkeys(features)]))
    opened = packed.withColumn("_blob", blob)
    values = {f: F.col("_blob").getField(f) for f in features}
    if fill:
        values = {f: sentinel_if_null(v) for f, v in values.items()}
    return opened.withColumns(values).drop("_blob", "features_json")


def packed_keys(packed: DataFrame) -> list[str]:
    """The names in the blobs of all rows; as many as the table had columns."""
    names = packed.select(F.explode(F.json_object_keys("features_json")).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def load_check(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Totals to verify a load: rows, labelled rows, rate."""
    y = F.col(label).cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(y).alias("fraud_count"),
        F.try_divide(F.sum(y), F.count(F.lit(1))).alias("fraud_rate"),
    )
