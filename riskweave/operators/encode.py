"""Label encoding of string columns, fitted and applied as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordering import sorted_codes
from riskweave.schemas import NULL_CATEGORY

#: values of a column that may be broadcast: some megabytes
BROADCAST_VALUES = 50_000


def fit_codes(df: DataFrame, columns: list[str], null_label: str = NULL_CATEGORY) -> DataFrame:
    """(column, value, code) for all columns from one distinct pass."""
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.coalesce(F.col(c).cast("string"), F.lit(null_label)).alias("value"),
                    )
                    for c in columns
                ]
            )
        ).alias("p")
    ).select("p.column", "p.value")
    return sorted_codes(pairs, "value", by=["column"])


def _pinned(codes: DataFrame, columns: list[str], most: int) -> tuple[DataFrame, set[str]]:
    """The codes, counted per column; those of columns with at most ``most`` values as a local table. Returns it and its columns."""
    wanted = codes.filter(F.col("column").isin(columns))
    sizes = {r["column"]: r["count"] for r in wanted.groupBy("column").count().collect()}  # a row per column
    small = {c for c in columns if sizes.get(c, 0) <= most}
    rows = wanted.filter(F.col("column").isin(sorted(small))).collect() if small else []
    return codes.sparkSession.createDataFrame(rows, codes.schema), small


def apply_codes(
    df: DataFrame,
    codes: DataFrame,
    columns: list[str],
    null_label: str = NULL_CATEGORY,
    suffix: str = "",
    unseen: int = 0,
    most: int = BROADCAST_VALUES,
) -> DataFrame:
    """Replace (or add, with a suffix) each column by its code.

    Each column decides by its own number of values: up to ``most`` are looked up in a broadcast
    table, which moves no rows; a larger vocabulary joins by shuffle.
    """
    local, small = _pinned(codes, columns, most)
    out = df
    for c in columns:
        own = (local if c in small else codes).filter(F.col("column") == c)
        lookup = own.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        key = F.coalesce(F.col(c).cast("string"), F.lit(null_label))
        out = (
            out.withColumn("_label", key)
            .join(F.broadcast(lookup) if c in small else lookup, F.col("_label") == F.col("_value"), "left")
            .withColumn(f"{c}{suffix}", F.coalesce("_code", F.lit(unseen)))
            .drop("_label", "_value", "_code")
        )
    return out
