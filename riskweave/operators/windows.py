"""Aggregates per key and time window, from a description; the same for tables and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what a measure may do with its column
_KINDS: dict[str, Callable[[str], Column]] = {"count": F.count, "sum": F.sum, "avg": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Windows:
    """Windows of one length per key, tumbling or sliding.

    ``measures``: result -> (kind, column). ``derived``: result -> a column made from results. ``ends``: whether the window's end is reported too.
    """

    key: str
    length: str
    measures: dict[str, tuple[str, str]]
    slide: str | None = None
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    ends: bool = False

    def over(self, rows: DataFrame, time: str = "created_at") -> DataFrame:
        """Key, ``window_start`` and results; windows without rows have none. On a stream, ``rows`` has its watermark."""
        unknown = {kind for kind, _ in self.measures.values()} - _KINDS.keys()
        if unknown:
            raise ValueError(f"measures are {sorted(_KINDS)}, not {sorted(unknown)}")
        window = F.window(time, self.length, self.slide) if self.slide else F.window(time, self.length)
        totals = rows.groupBy(F.col(self.key), window.alias("_window")).agg(
            *[_KINDS[kind](column).alias(name) for name, (kind, column) in self.measures.items()]
        )
        border = {"window_start": F.col("_window.start"), **({"window_end": F.col("_window.end")} if self.ends else {})}
        made = {name: make() for name, make in self.derived.items()}
        return totals.withColumns({**border, **made}).select(self.key, *border, *self.measures, *made)
