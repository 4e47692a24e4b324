"""Keyed topic writers: broker, or JSON text files in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish(payload: DataFrame, bootstrap: str, topic: str) -> None:
    """Send (key, value) rows. Needs the Kafka connector package."""
    (
        payload.write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("kafka.enable.idempotence", "true")
        .option("kafka.acks", "all")
        .option("kafka.compression.type", "snappy")
        .option("kafka.linger.ms", "10")
        .option("kafka.batch.size", "65536")
        .option("topic", topic)
        .save()
    )


def publish_files(payload: DataFrame, path: str) -> None:
    """One JSON value per line; the key is a field of the value already."""
    payload.select("value").write.mode("append").text(path)
