"""Classification and regression metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordering import running_totals
from riskweave.schemas import CLASS_CUTOFF


def binary_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC-AUC, average precision and F1 in one row.

    Rows first collapse to one per distinct score (partial sums before the
    shuffle), so ties are one step of the curve; cumulative counts then use
    ranges of equal numbers of steps, however close the scores lie.
    """
    y = F.col(label).cast("int")
    steps = df.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    curve = running_totals(steps, F.col("s"), ["pos", "neg"], descending=True)
    c = F.col
    predicted = c("s") > CLASS_CUTOFF
    sums = curve.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(c("neg") * (c("cum_pos") - c("pos") / 2)).alias("ranked_pairs"),
        F.sum(c("pos") * c("cum_pos") / (c("cum_pos") + c("cum_neg"))).alias("precision_sum"),
        F.sum(F.when(predicted, c("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted, c("neg")).otherwise(0)).alias("fp"),
    )
    return sums.select(
        (c("p") + c("n")).alias("n_rows"),
        c("p").alias("n_positive"),
        F.try_divide(c("ranked_pairs"), c("p") * c("n")).alias("roc_auc"),
        F.try_divide(c("precision_sum"), c("p")).alias("average_precision"),
        F.coalesce(F.try_divide(2 * c("tp"), c("tp") + c("fp") + c("p")), F.lit(0.0)).alias("f1"),
    )


def regression_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """MAE, RMSE and R-squared from one aggregate."""
    error = truth - predicted
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(error * error), F.var_pop(truth))).alias("r2"),
    )
