"""Latest / first row per key, de-duplication and bounded small sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    Filtering ``row_number`` lets Spark keep only ``k`` rows per key in each
    map task before the shuffle, so a hot key costs k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k)
    return numbered.withColumnRenamed("_rank", rank) if rank else numbered.drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    return top_per_key(df, keys, [F.desc(c) for c in newest])


def first_write_wins(batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``batch`` to insert: one per key, and none whose key exists."""
    fresh = top_per_key(batch, keys, order)
    if target is None:
        return fresh
    # the target's keys are first reduced to those of the batch: a small batch
    # is broadcast into a scan of the target, which is then never shuffled
    known = target.select(*keys).join(fresh.select(*keys), keys, "left_semi")
    return fresh.join(known, keys, "left_anti")


def first_of_stored(batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[Column], most: int = SMALL_ROWS) -> DataFrame:
    """``first_write_wins`` for a wide batch that reads a written table and may be passed over again.

    Only keys and their hashes are shuffled, and whole rows where more than ``most`` keys are new beside known ones, or repeated.
    """
    if target is not None:
        known = target.select(*keys)
        unseen = batch.select(*keys).join(known, keys, "left_anti").distinct().toDF(*[f"_new_{k}" for k in keys])
        found = small_or_same(unseen, most)
        new = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
        batch = batch.join(found, reduce(lambda a, b: a & b, new), "left_semi")
        if found is unseen:
            return top_per_key(batch, keys, order)
    hashed = F.xxhash64(*keys)
    again = batch.groupBy(hashed.alias("_again")).count().filter("count > 1").select("_again")
    found = small_or_same(again, most)
    if found is again:
        return top_per_key(batch, keys, order)
    shared = hashed == F.col("_again")
    return batch.join(found, shared, "left_anti").unionByName(top_per_key(batch.join(found, shared, "left_semi"), keys, order))


def small_or_same(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Pin a side and mark it for broadcast when, and only when, it is small.

    At most ``max_rows + 1`` rows reach the driver. A larger side is returned
    untouched and joins by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
