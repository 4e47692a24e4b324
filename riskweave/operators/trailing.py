"""Trailing-window sums and moments that survive hot keys.

A plain ``RANGE BETWEEN span PRECEDING`` window puts every row of a key in one
task and re-adds the whole frame for each row. Here time is cut into buckets
and a span is a whole number of them, so the frame of a row at offset ``o`` of
bucket ``b`` is

    rows of bucket b - n with offset >= o     (halo, a running total from the end)
  + whole buckets b - n + 1 .. b - 1          (pre-aggregated totals)
  + rows of bucket b with offset <= o         (own, a running total from the start)

Each row is sent to its own bucket and once per span to the bucket that needs
it as halo. The shuffle key is (key, bucket), so one key spreads over as many
tasks as it has buckets, and every total is a running one: linear, and free of
the cancellation that differences of prefix sums suffer.

Whole numbers suffer none, so their halo is its total less what has left the
frame by offset o: that needs no second order of the rows, and allows spans
shorter than a bucket.

Rows that are sorted carry the columns that are asked for in the end, and no
others; a task sorts about ``TASK_ROWS`` of them, however many rows there are.

The whole buckets of a long span are a trailing frame over bucket totals, and
are found the same way with wider buckets: hours of the first and of the last
day, and whole days between. So no frame that slides has more entries than a
span has days, however many hours that is.

Moments are (n, mean as a whole number and a rest, sum of squared distances
from the mean, least, most). Rows are taken up one by one and parts merged pairwise, which keeps their
precision at any magnitude; least and most tell a spread of exactly zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.scalars import micros

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

_OWN = -1
_TOTAL = -2

#: rows, copies included, that one task sorts: some 150 MB
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Span:
    """One trailing frame: rows at most ``length`` microseconds older.

    ``strict`` leaves out rows exactly ``length`` old.
    """

    name: str
    length: int
    measures: tuple[str, ...]
    strict: bool = False


# --- what can be added up ---------------------------------------------------


@dataclass(frozen=True)
class Total:
    """How a measure is totalled: over a group, over a window, and from parts; ``totals`` does so over totals.

    ``exact``: totals are whole numbers, and their differences lose nothing.
    """

    group: Callable[[Column], Column]
    over: Callable[[Column, object], Column]
    merge: Callable[[list[Column]], Column]
    totals: Total | None = None
    exact: bool = False


def _added(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


SUM = Total(F.sum, lambda x, window: F.sum(x).over(window), _added)
WHOLE = replace(SUM, exact=True)


def _moments(x: Column, over: Callable[[Column], Column]) -> Column:
    # whole numbers add up exactly: the mean is one of them and a small rest, so its distance from an amount is exact at any magnitude
    n, floors = over(F.count(x)), over(F.sum(F.floor(x).cast("double")))
    whole = F.floor(floors / n).cast("double")
    return F.struct(
        n.cast("double").alias("n"),
        F.coalesce(whole, F.lit(0.0)).alias("whole"),
        F.coalesce((floors - whole * n + over(F.sum(x - F.floor(x)))) / n, F.lit(0.0)).alias("rest"),
        F.coalesce(over(F.var_pop(x)) * n, F.lit(0.0)).alias("squares"),
        over(F.min(x)).cast("double").alias("least"),
        over(F.max(x)).cast("double").alias("most"),
    )


_NOTHING = "named_struct('n', 0D, 'whole', 0D, 'rest', 0D, 'squares', 0D, 'least', CAST(NULL AS DOUBLE), 'most', CAST(NULL AS DOUBLE))"


def mean_of(moments: Column) -> Column:
    return F.when(moments["n"] > 0, moments["whole"] + moments["rest"])


def from_mean(x: Column, moments: Column) -> Column:
    """How far a value lies from the mean; null where there is none."""
    return F.when(moments["n"] > 0, x - moments["whole"] - moments["rest"])


def _merged(parts: Column) -> Column:
    """One set of moments from an array of them."""

    def pair(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], (b["whole"] - a["whole"]) + (b["rest"] - a["rest"])
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        first = a["n"] > 0
        return F.struct(
            n.alias("n"),
            F.when(first, a["whole"]).otherwise(b["whole"]).alias("whole"),
            F.when(first, a["rest"] + apart * share).otherwise(b["rest"]).alias("rest"),
            (a["squares"] + b["squares"] + F.when(first, apart * apart * a["n"] * share).otherwise(0.0)).alias("squares"),
            F.least(a["least"], b["least"]).alias("least"),
            F.greatest(a["most"], b["most"]).alias("most"),
        )

    return F.aggregate(F.array_compact(parts), F.expr(_NOTHING), pair)


_OF_MOMENTS = Total(
    lambda x: _merged(F.sort_array(F.collect_list(x))),
    lambda x, window: _merged(F.collect_list(x).over(window)),
    lambda parts: _merged(F.array(*parts)),
)
MOMENTS = Total(
    lambda x: _moments(x, lambda c: c),
    lambda x, window: _moments(x, lambda c: c.over(window)),
    lambda parts: _merged(F.array(*parts)),
    _OF_MOMENTS,
)


# --- frames -----------------------------------------------------------------


def trailing_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    measures: dict[str, Column],
    spans: list[Span],
    bucket: int,
) -> DataFrame:
    """Add ``<span>_<measure>`` columns; rows at the same instant are peers.

    A span is a whole number of buckets or, where all measures are whole numbers, shorter than one.
    """
    kinds = df.select(*[m.alias(name) for name, m in measures.items()]).schema
    totals = {name: WHOLE if isinstance(kinds[name].dataType, T.IntegralType) else SUM for name in measures}
    return _trailing(df, keys, ts, {name: (m, totals[name]) for name, m in measures.items()}, spans, bucket)


def trailing_moments(df: DataFrame, keys: list[str], ts: str, measures: dict[str, Column], spans: list[Span], bucket: int) -> DataFrame:
    """Add ``<span>_<measure>`` structs: n, whole, rest, squares, least, most of the frame's values that are not null; see ``mean_of``."""
    return _trailing(df, keys, ts, {name: (m, MOMENTS) for name, m in measures.items()}, spans, bucket)


def _trailing(df: DataFrame, keys: list[str], ts: str, measures: dict[str, tuple[Column, Total]], spans: list[Span], bucket: int) -> DataFrame:
    exact = all(total.exact for _, total in measures.values())
    for span in spans:
        if span.length % bucket and not (exact and span.length < bucket):
            raise ValueError(f"span {span.name} is not a whole number of buckets")
    at = micros(ts)
    # rows without a time have no frame; spread them so they cannot pile up
    spread = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1024))
    # columns by themselves rather than as one struct: those that nobody selects later are not even shuffled
    carried = {f"_c_{i}": c for i, c in enumerate(df.columns)}
    rows = df.select(
        *[F.col(c).alias(name) for name, c in carried.items()],
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        at.alias("_at"),
        spread.alias("_spread"),
        *[F.when(at.isNotNull(), m).alias(f"_m_{name}") for name, (m, _) in measures.items()],
    )
    levels = [bucket, DAY] if bucket < DAY and DAY % bucket == 0 else [bucket]
    totals = {name: total for name, (_, total) in measures.items()}
    out = _framed(rows, [f"_key_{k}" for k in keys], totals, spans, levels, 0, list(carried), _tasks(df, len(spans) + 2))
    timed = F.col("_at").isNotNull()
    return out.select(
        *[F.col(name).alias(c) for name, c in carried.items()],
        *[F.when(timed, F.col(f"_s_{s.name}_{m}")).alias(f"{s.name}_{m}") for s in spans for m in s.measures],
    )


def _tasks(df: DataFrame, copies: int) -> int | None:
    """How many tasks sort at most ``TASK_ROWS`` rows each; none if the session's own are enough. Counting a scan reads no column.

    The session's own are no more than its cores where Spark joins small partitions, and no more than its shuffle partitions where it does not.
    """
    wanted, spark = df.count() * copies // TASK_ROWS + 1, df.sparkSession
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wanted if wanted > usual else None


def _dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return df.repartition(tasks, *by) if tasks else df


def _framed(
    rows: DataFrame, keys: list[str], totals: dict[str, Total], spans: list[Span], levels: list[int], last: int, carried: list[str], tasks: int | None
) -> DataFrame:
    """``keys``, ``_at``, ``carried`` and ``_s_<span>_<measure>`` of every row.

    A frame ends with the row's own instant, or ``last`` units of its bucket
    before (0, or -1: only what is earlier). ``levels``: the bucket width, and those of the
    wider buckets that its totals go into.
    """
    bucket = levels[0]
    at = F.col("_at")
    offset = F.coalesce(F.pmod(at, F.lit(bucket)), F.lit(0))
    exact = all(total.exact for total in totals.values())
    measured = [f"_m_{name}" for name in totals]
    copy = _leaving if exact else _halo
    copies = [_copy(_OWN, F.lit(0), F.col("_offset")), *[copy(i, s, bucket, len(spans)) for i, s in enumerate(spans)]]
    number = ((at - offset) / bucket).cast("long")
    own = F.col("_copy.kind") == _OWN
    placed = rows.select("*", number.alias("_bucket"), offset.alias("_offset")).select("*", F.explode(F.array(*copies)).alias("_copy")).select(
        *keys,
        F.coalesce(F.col("_bucket") + F.col("_copy.shift"), F.col("_spread") if "_spread" in rows.columns else F.col("_bucket")).alias("_bucket"),
        F.col("_copy.offset").alias("_offset"),
        F.col("_copy.kind").alias("_kind"),
        *measured,
        *[F.when(own, F.col(c)).alias(c) for c in ["_at", *carried]],
    )
    wide = [s for s in spans if s.length // bucket > 1]
    if wide:
        timed = rows.filter(at.isNotNull()).select(*keys, ((at - F.pmod(at, F.lit(bucket))) / bucket).cast("long").alias("_bucket"), *measured)
        whole = _dealt(timed, tasks, *keys, "_bucket").groupBy(*keys, "_bucket")
        whole = whole.agg(*[totals[name].group(F.col(f"_m_{name}")).alias(f"_m_{name}") for name in totals])
        between = _between(whole, keys, totals, wide, levels, tasks)
        placed = placed.unionByName(
            between.select(
                *keys, "_bucket", F.lit(-1).cast("long").alias("_offset"), F.lit(_TOTAL).alias("_kind"),
                *[F.col(f"_s_{s.name}_{m}").alias(f"_t_{s.name}_{m}") for s in wide for m in s.measures],
            ),
            allowMissingColumns=True,
        )
    placed = _dealt(placed, tasks, *keys, "_bucket")
    in_bucket = Window.partitionBy(*keys, "_bucket")
    forward = in_bucket.orderBy("_offset").rangeBetween(Window.unboundedPreceding, last)
    kind = F.col("_kind")
    heads = [totals[m].over(F.when(kind == _OWN, F.col(f"_m_{m}")), forward).alias(f"_own_{m}") for m in totals]
    # the one row with totals stands before all others of its bucket
    middles = [F.max(F.col(f"_t_{s.name}_{m}")).over(forward).alias(f"_mid_{s.name}_{m}") for s in wide for m in s.measures]
    if exact:
        by_now = in_bucket.orderBy("_offset").rangeBetween(Window.unboundedPreceding, 0)
        ever = in_bucket.orderBy("_offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        halos = []
        for i, s in enumerate(spans):
            for m in s.measures:
                entered = totals[m].over(F.when(kind == i, F.col(f"_m_{m}")), ever)
                left = totals[m].over(F.when(kind.isin(i, i + len(spans)), F.col(f"_m_{m}")), by_now)
                halos.append((F.coalesce(entered, F.lit(0)) - F.coalesce(left, F.lit(0))).alias(f"_halo_{s.name}_{m}"))
        out = placed.select("*", *heads, *middles, *halos).filter(kind == _OWN)
    else:
        backward = in_bucket.orderBy(F.desc("_offset")).rangeBetween(Window.unboundedPreceding, 0)
        halos = [
            totals[m].over(F.when(kind == i, F.col(f"_m_{m}")), backward).alias(f"_halo_{s.name}_{m}") for i, s in enumerate(spans) for m in s.measures
        ]
        # the halo's rows have done their part: they are not sorted again
        out = placed.select("*", *halos).filter(kind < 0).select("*", *heads, *middles).filter(kind == _OWN)

    def frame(s: Span, m: str) -> Column:
        parts = [F.col(f"_halo_{s.name}_{m}"), *([F.col(f"_mid_{s.name}_{m}")] if s in wide else []), F.col(f"_own_{m}")]
        return totals[m].merge(parts).alias(f"_s_{s.name}_{m}")

    return out.select(*keys, "_at", *carried, *[frame(s, m) for s in spans for m in s.measures])


def _between(whole: DataFrame, keys: list[str], totals: dict[str, Total], spans: list[Span], levels: list[int], tasks: int | None) -> DataFrame:
    """``keys``, ``_bucket`` and, per span, the total of the whole buckets between a bucket and the one a span before it."""
    bucket, wider = levels[0], levels[1:]
    above = {name: total.totals or total for name, total in totals.items()}
    deep = [s for s in spans if wider and s.length % wider[0] == 0]
    flat = [s for s in spans if s not in deep]
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    out = whole.select(
        *keys, "_bucket", *[f"_m_{name}" for name in totals],
        *[
            above[m].over(F.col(f"_m_{m}"), by_key.rangeBetween(-(s.length // bucket - 1), -1)).alias(f"_s_{s.name}_{m}")
            for s in flat
            for m in s.measures
        ],
    )
    if not deep:
        return out
    # instants in units of a bucket: what lies strictly between is strict at both ends
    units = [Span(s.name, s.length // bucket, s.measures, strict=True) for s in deep]
    carried = [f"_s_{s.name}_{m}" for s in flat for m in s.measures]
    framed = _framed(out.withColumnRenamed("_bucket", "_at"), keys, above, units, [w // bucket for w in wider], -1, carried, tasks)
    return framed.withColumnRenamed("_at", "_bucket")


def _halo(i: int, span: Span, bucket: int, spans: int) -> Column:
    """The copy that stays in the frames of a later bucket up to its own offset."""
    return _copy(i, F.lit(span.length // bucket), F.col("_offset") - int(span.strict))


def _leaving(i: int, span: Span, bucket: int, spans: int) -> Column:
    """The copy that leaves the frames of a bucket at an offset: of a later bucket, or (its kind raised by ``spans``) of its own."""
    whole, rest = divmod(span.length, bucket)
    leaves = F.col("_offset") + rest
    shift = whole + (leaves >= bucket).cast("int")
    return _copy(F.when(shift > 0, i).otherwise(i + spans), shift, F.pmod(leaves, F.lit(bucket)) + int(not span.strict))


def _copy(kind: int | Column, shift: Column, offset: Column) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, int) else kind).alias("kind"),
        shift.cast("long").alias("shift"),
        offset.cast("long").alias("offset"),
    )
