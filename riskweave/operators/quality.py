"""Row rules, table-level rule reports and referential checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.schemas import DECISIONS, REQUIRED_EVENT_FIELDS


def transaction_rules() -> dict[str, Column]:
    """Rule name -> condition that must hold. Null optional fields pass."""
    amount = F.col("amount")
    rules = {f"{name}_present": F.col(name).isNotNull() for name in REQUIRED_EVENT_FIELDS}
    rules["amount_range"] = amount.isNull() | ((amount > 0) & (amount <= 100000))
    rules["hour_range"] = F.coalesce(F.col("hour_of_day").between(0, 23), F.lit(True))
    rules["day_range"] = F.coalesce(F.col("day_of_week").between(0, 6), F.lit(True))
    rules["velocity_range"] = F.coalesce(F.col("txn_velocity_1h") >= 0, F.lit(True))
    rules["ratio_positive"] = F.coalesce(F.col("amount_vs_avg_ratio") > 0, F.lit(True))
    return rules


def tag_failures(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add ``failed_rules``, the names of the rules a row breaks."""
    rules = rules or transaction_rules()
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed_rules", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their failed rules).

    Rows are told apart by plain conditions; only what breaks one has its rules named.
    """
    rules = rules or transaction_rules()
    valid = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules.values()])
    return df.filter(valid), tag_failures(df.filter(~valid), rules)


def rule_report(df: DataFrame, violations: dict[str, Column], tables: dict[str, Column] | None = None) -> DataFrame:
    """(rule, violations, passed) from a single pass.

    ``violations`` are row conditions that count against a rule; ``tables`` are
    aggregate conditions on the whole table, true when they hold.
    """
    tables = tables or {}
    one_row = df.agg(
        *[F.count_if(bad).alias(name) for name, bad in violations.items()],
        *[F.when(ok, 0).otherwise(1).cast("long").alias(name) for name, ok in tables.items()],
    )
    names = [*violations, *tables]
    return one_row.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names])
        )
    ).withColumn("passed", F.col("violations") == 0)


def risk_table_rules() -> tuple[dict[str, Column], dict[str, Column]]:
    score, verdict = F.col("composite_risk_score"), F.col("decision")
    rows = {
        "txn_id_not_null": F.col("txn_id").isNull(),
        "score_in_0_100": ~F.coalesce(score.between(0, 100), F.lit(False)),
        "probability_in_0_1": ~F.coalesce(F.col("fraud_probability").between(0, 1), F.lit(False)),
        "decision_allowed": ~F.coalesce(verdict.isin(DECISIONS), F.lit(False)),
    }
    rate = F.try_divide(F.count_if(F.col("is_fraud")), F.count(F.lit(1)))
    tables = {
        "label_rate_plausible": rate.between(0.001, 0.5),
        "at_least_100_rows": F.count(F.lit(1)) >= 100,
        "not_empty": F.count(F.lit(1)) > 0,
    }
    return rows, tables


def disallowed_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(allowed)).select(column).distinct()


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """One row: how many child rows have a non-null key without a parent.

    Child rows are counted per key before the join, so a hot key is one row.
    """
    counted = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = counted.join(parent.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("foreign_key"), "violations")
