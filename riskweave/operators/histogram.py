"""Equal-width histograms of many features with edges from one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.schemas import PSI_BINS


def to_long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value) without nulls; unpivot inside the row."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    )
    return df.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def edges(long: DataFrame, side: str, by: list[str]) -> DataFrame:
    """Lowest and highest edge per group; a constant widens by half a unit."""
    spread = long.filter(F.col("side") == side).groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return spread.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def bin_of(value: Column, lo: Column, hi: Column, bins: int = PSI_BINS) -> Column:
    """Bin 0..bins-1, left-closed and the last one closed; null outside.

    Counts the inner edges at or below the value. Comparing with each edge
    places border values exactly, which dividing by the width would not.
    """
    step = (hi - lo) / bins
    inner = F.lit(0)
    for i in range(1, bins):
        inner = inner + (value >= F.lit(float(i)) * step + lo).cast("int")
    return F.when((value >= lo) & (value <= hi), inner)


def histogram(long: DataFrame, side_with_edges: str, by: list[str], bins: int = PSI_BINS) -> DataFrame:
    """(by..., side, bin, n): values outside the edges get a null bin.

    ``by`` must be a bounded grouping (features, runs): the edge table has one
    row per group and is broadcast. A group without rows on the side with edges
    stays, with null bins.
    """
    bounds = edges(long, side_with_edges, by)
    placed = long.join(F.broadcast(bounds), by, "left").withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins))
    return placed.groupBy(*by, "side", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
