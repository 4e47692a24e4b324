"""JDBC reader and writer. The driver jar must be on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_query(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table over parallel connections.

    Filters, column lists and limits applied to the result are pushed into the
    database by Spark's JDBC source.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    reader = reader.option("fetchsize", fetch_size).option("pushDownLimit", "true").option("pushDownPredicate", "true")
    if partition_column:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions)
        )
    return reader.load()


def append_table(df: DataFrame, url: str, table: str, properties: dict[str, str], batch_size: int = 10_000) -> None:
    writer = df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table)
    writer.options(**properties).option("batchsize", batch_size).save()
