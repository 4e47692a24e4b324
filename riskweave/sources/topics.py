"""Message-topic sources: broker, and files that stand in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskweave.schemas import TRANSACTIONS_TOPIC


def kafka_stream(
    spark: SparkSession,
    bootstrap: str,
    topic: str = TRANSACTIONS_TOPIC,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Raw topic rows (key, value, timestamp). Needs the Kafka connector package.

    ``earliest`` lets a first run see what was published before it started.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", "false")
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load()


def replay(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100, glob: str | None = None
) -> DataFrame:
    """Stored Parquet history as a stream, a bounded number of files at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def json_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Topic payloads stored as text files, one JSON value per line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
