"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv_wanted(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Columns of ``wanted`` (name -> type) that the CSV header has.

    Only the header is probed; types are declared rather than inferred, so the
    data is read once, and the unselected columns are never parsed. A cell that
    is not of its type is null.
    """
    header = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.select(*[F.col(c).try_cast(wanted[c]).alias(c) for c in wanted if c in header])


def parquet_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def table_probe(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row per table: rows, and which required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(missing)).alias("n_missing_columns"),
        (F.col("n_rows") > 0).alias("has_rows"),
    )


def require_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a clear error before any work starts."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table {name} does not exist; load it first")
    return spark.table(name)
