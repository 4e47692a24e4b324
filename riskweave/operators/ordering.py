"""Global order without a global sort in one task.

Rows are cut into ranges of about equal size, sorted inside them, and written
once with the number of their range and their place in it. What lies in the ranges
before comes from one total per range, so positions and running sums
need no row to pass through a single task, however the values crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialize

_PLACE_BITS = 33


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range`` and ``_place``, which together number them in order.

    Rows that are equal in ``order`` share a range, so it should tell them apart. The
    borders come from a sample; written rows keep the range they got.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the number of the partition, and in its lower bits the row's number in it
    stored = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    return stored.select(
        *df.columns, F.shiftright("_id", _PLACE_BITS).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place")
    )


def _before(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per range, what all ranges before it add up to; as many rows as there are ranges."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.groupBy("_range").agg(*[total.alias(f"_t_{name}") for name, total in totals.items()])
    return summed.select("_range", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in totals])


def running_totals(df: DataFrame, order: Column, measures: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add ``cum_<measure>``: the sum over this row and all rows ordered before. ``order`` differs from row to row."""
    rows = ranged(df, [order.desc() if descending else order.asc()], ranges)
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(m).over(inside).alias(f"_w_{m}") for m in measures])
    offsets = _before(rows, {m: F.sum(m) for m in measures})
    return summed.join(F.broadcast(offsets), "_range").select(
        *df.columns, *[(F.col(f"_w_{m}") + F.col(f"_b_{m}")).alias(f"cum_{m}") for m in measures]
    )


def sorted_codes(values: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Index of each distinct value in the sorted list, per ``by`` group.

    Two exchanges for any number of groups and values: one for the distinct values, one for
    their ranges. Ranges and groups are few, so their offsets are broadcast.
    """
    by = by or []
    rows = ranged(values.select(*by, value).distinct(), [F.col(c) for c in [*by, value]], ranges)
    placed = rows.join(F.broadcast(_before(rows, {"rows": F.count(F.lit(1))})), "_range").withColumn("_number", F.col("_place") + F.col("_b_rows"))
    if not by:
        return placed.select(value, F.col("_number").cast("int").alias("code"))
    first = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_number").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return placed.join(F.broadcast(first), same).select(*by, value, (F.col("_number") - F.col("_first")).cast("int").alias("code"))
