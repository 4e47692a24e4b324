"""Scalar column helpers. Everything stays inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schemas import CATEGORY_BASE_RATES, SENTINEL


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; accepts both timestamp types."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def elapsed_hour(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def elapsed_day(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 86400), F.lit(7)).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (least/greatest alone would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def clean_amount(amount: Column) -> Column:
    return F.round(clip(amount, 0.50, 50000.0), 2)


def equal_flag(left: Column, right: Column) -> Column:
    """1 when equal; a null on either side never equals anything."""
    return F.coalesce(left == right, F.lit(False)).cast("int")


def tf_flag(value: Column) -> Column:
    return F.when(value == "T", 1).when(value == "F", 0).otherwise(-1)


def spend_ratio(amount: Column, avg_monthly_spend: Column) -> Column:
    """Amount against the account's average daily spend, at least one unit."""
    return F.round(amount / F.greatest(avg_monthly_spend / 30, F.lit(1.0)), 4)


def null_if_sentinel(value: Column) -> Column:
    return F.when(value != SENTINEL, value)


def sentinel_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(SENTINEL).cast("double"))


def describe(feature: Column, descriptions: dict[str, str]) -> Column:
    """Readable text for a feature name; the name itself when unknown."""
    pairs = [F.lit(part) for item in descriptions.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), feature), feature)


def base_rate(category: Column) -> Column:
    """Base fraud rate of a category; 0 for an unseen one."""
    pairs = [F.lit(part) for item in CATEGORY_BASE_RATES.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(0.0))


def uniform01(key: Column, salt: str = "") -> Column:
    """Repeatable uniform draw in [0, 1) from a string key.

    The first 32 bits of md5 give the same draw in any engine and any process.
    """
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def event_key(*parts: Column) -> Column:
    """Idempotency key that a replay reproduces."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
