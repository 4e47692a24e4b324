"""Table writers on plain Parquet folders."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.keyed import first_write_wins, top_per_key
from riskweave.sources.files import parquet_if_exists

_EPOCH, _DAY = "_epoch", "_day"


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only audit tables."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def insert_new(
    spark: SparkSession, batch: DataFrame, path: str, keys: list[str], order: list[Column], partition_by=None
) -> None:
    """Insert rows whose key is new; the first row ever written for a key stays.

    Running it again with the same batch adds nothing. Of the target only the
    key columns are read.
    """
    append(first_write_wins(batch, parquet_if_exists(spark, path), keys, order), path, partition_by)


@dataclass(frozen=True)
class Part:
    """One folder of rows of a keyed log. ``level`` counts how often its rows were merged."""

    path: str
    level: int


def merge_due(parts: list[Part], fanout: int) -> list[Part]:
    """The parts of the lowest level that has ``fanout`` of them, or none."""
    for level in sorted({p.level for p in parts}):
        same = [p for p in parts if p.level == level]
        if len(same) >= fanout:
            return same
    return []


class KeyedLog:
    """Keyed upsert without a table format: merge on read, over a bounded number of folders.

    Each epoch of a stream writes the rows it changed to a folder of its own, and then a manifest, which lists the folders that make up the table; the
    current table is the newest row per key over them. As soon as a level has ``fanout`` folders, the sink merges them into one of the next level before
    it writes the manifest. So after n epochs a table has at most ``fanout`` - 1 folders on each of its log(n) levels, and a row is rewritten once per level.

    Nothing that a manifest lists is changed, apart from the epoch that is redone, so readers never see a gap. A redo after a lost executor or driver starts from the manifest
    before the epoch and gives the same table. Manifests and folders lie in groups of ``GROUP`` epochs: finding the newest lists two short folders.

    With ``day``, a date that follows from the key, folders are partitioned by it: merges and reads with a time range touch the days they need.
    With ``first`` the first row ever written for a key stays instead; inside an epoch the one that comes first by those columns.
    ``unique``: no epoch has two rows of a key, as with an aggregation by it. A table that is one folder of unique keys is read as it stands.
    """

    GROUP = 1000

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], first: list[Column] | None = None, day: Column | None = None, fanout: int = 8, unique: bool = False
    ):
        if fanout < 2:
            raise ValueError("fewer than two folders cannot be merged")
        self.spark, self.path, self.keys, self.first, self.day, self.fanout, self.unique = spark, path.rstrip("/"), keys, first, day, fanout, unique
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write_epoch(self, df: DataFrame, epoch: int) -> None:
        """Write the rows of an epoch, merge what is due, and list the result."""
        epoch = int(epoch)
        if self.first is not None:
            df = top_per_key(df, self.keys, self.first)
        rows = df.withColumn(_EPOCH, F.lit(epoch).cast("long"))
        if self.day is not None:
            rows = rows.withColumn(_DAY, F.to_date(self.day))
        part = Part(f"epochs/{epoch // self.GROUP}/{epoch}", 0)
        self._write(rows, part)
        parts = self._parts(self._newest(before=epoch))
        if self._has_rows(part):
            parts.append(part)
        while due := merge_due(parts, self.fanout):
            parts = self._merged(parts, due, epoch)
        self._list(parts, epoch)

    def compact(self) -> None:
        """Merge the whole table into one folder."""
        newest = self._newest()
        parts = self._parts(newest)
        if len(parts) > 1:
            self._list(self._merged(parts, parts, newest), newest)

    def current(self, since: Column | None = None, until: Column | None = None) -> DataFrame | None:
        """One row per key, newest or first; with ``day``, of the days that a time range touches."""
        parts = self.parts()
        if not parts:
            return None
        rows = self._read(parts)
        if self.day is not None:
            rows = rows.filter(F.col(_DAY) >= F.to_date(since)) if since is not None else rows
            rows = rows.filter(F.col(_DAY) <= F.to_date(until)) if until is not None else rows
        elif since is not None or until is not None:
            raise ValueError("a time range needs a table that is partitioned by day")
        # an epoch of a log with ``first``, and what was merged, has one row per key
        single = len(parts) == 1 and (self.unique or self.first is not None or parts[0].level > 0)
        return (rows if single else self._one_per_key(rows)).drop(_EPOCH, _DAY)

    def parts(self) -> list[Part]:
        """The folders that a reader opens."""
        return self._parts(self._newest())

    # rows

    def _write(self, rows: DataFrame, part: Part) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(_DAY) if self.day is not None else writer).parquet(f"{self.path}/{part.path}")

    def _read(self, parts: list[Part]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.path}/{p.path}") for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        return top_per_key(rows, self.keys, [F.desc(_EPOCH) if self.first is None else F.asc(_EPOCH)])

    def _merged(self, parts: list[Part], due: list[Part], epoch: int) -> list[Part]:
        level = 1 + max(p.level for p in due)
        merged = Part(f"merged/{epoch // self.GROUP}/{epoch}-{level}", level)
        rows = self._one_per_key(self._read(due))
        # one task per day would be a hot spot; rebalance splits large days
        self._write(rows.hint("rebalance", F.col(_DAY)) if self.day is not None else rows, merged)
        return [p for p in parts if p not in due] + [merged]

    def _has_rows(self, part: Part) -> bool:
        """An epoch without rows and with days leaves an empty folder, which has no schema to read."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/{part.path}"))]
        return any(not n.startswith(("_SUCCESS", ".")) for n in names)

    # manifests

    def _manifest(self, epoch: int) -> str:
        return f"{self.path}/manifest/{epoch // self.GROUP}/{epoch}.json"

    def _list(self, parts: list[Part], epoch: int) -> None:
        text = json.dumps({"epoch": epoch, "parts": [[p.path, p.level] for p in parts]})
        draft, final = self._hadoop(self._manifest(epoch) + ".draft"), self._hadoop(self._manifest(epoch))
        out = self._fs.create(draft, True)
        out.writeBytes(text)
        out.close()
        self._fs.delete(final, False)  # a redo lists the same epoch again
        if not self._fs.rename(draft, final):
            raise OSError(f"could not write {final}")

    def _parts(self, epoch: int | None) -> list[Part]:
        if epoch is None:
            return []
        stream = self._fs.open(self._hadoop(self._manifest(epoch)))
        try:
            listed = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return [Part(path, level) for path, level in listed["parts"]]

    def _newest(self, before: int | None = None) -> int | None:
        """The newest listed epoch, or the newest before one."""
        for group in sorted(map(int, self._names("manifest")), reverse=True):
            epochs = [int(n.removesuffix(".json")) for n in self._names(f"manifest/{group}") if n.endswith(".json")]
            found = max((e for e in epochs if before is None or e < before), default=None)
            if found is not None:
                return found
        return None

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return [n for n in names if not n.startswith(".")]

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)
