"""Starting, triggering and awaiting groups of streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def start(
    stream: DataFrame,
    name: str,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    output_mode: str = "update",
    once: bool = False,
) -> StreamingQuery:
    """Start one query with its own checkpoint.

    Without ``every`` it processes what is available and stops. Empty batches
    are not written; a batch is kept while in use, so asking does not compute
    it a second time. ``once``: ``write_batch`` passes over a batch a single time
    and copes with one without rows, so none is kept.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if once:
            write_batch(batch, epoch)
            return
        batch.persist()
        try:
            if not batch.isEmpty():
                write_batch(batch, epoch)
        finally:
            batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(write)
        .queryName(name)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def await_all(queries: list[StreamingQuery]) -> None:
    """Wait for a finite run; one failure stops the others and is raised."""
    try:
        for query in queries:
            query.awaitTermination()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def await_any(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Run until one query ends or the user interrupts, then stop all."""
    try:
        spark.streams.awaitAnyTermination()
    except KeyboardInterrupt:
        pass
    finally:
        for query in queries:
            if query.isActive:
                query.stop()
