"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go.

A line counts without white space at its ends. A line is removed if an equal line, or one within edit distance one of it (one character
inserted, removed or replaced), starts earlier, by doc_id, then line number; lines are judged on the input, not on what is left. The
query lets every line that is not blank take part: equal lines meet at any length, and one edit counts where the longer of the two has
``NEAR`` characters, as in shorter ones it is a large part of the line (``1.`` and ``2.``, ``of`` and ``or``).

Two lines within one edit share a variant: both without the character at the same place (replaced), or the longer without one character is
the shorter. Variants are hashed keys, from running hashes of the line, so a line of n characters costs n steps. As key, the first kind carries
length and place, so all lines under it are within one edit of each other, and the second kind is met by one line as it is; so
the earliest partner of every line comes from minima per key, and no pairs are listed, however many lines meet. Edit distance is then
verified on the texts.

Most lines have no partner. One edit leaves the first or the second half of a line as it is, so lines emit variants only if a sketch of
both halves' hashes (``counts``) estimates that another distinct line shares one; and variants are shuffled only if a second sketch estimates
that they meet. Equal lines are one line up to the last join, where a line that a third of all documents hold is split by Spark.

A null text stays null, an empty one stays empty. Rows that share a doc_id count as one document: lines at the same number are not earlier than
each other, so repeated rows all stay alike. A null doc_id comes first. An empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import documents, id_key, keyed_rows, stored
from riskweave.llm.counts import Repeated, repeated
from riskweave.llm.text import mix, powers

#: where callers say nothing: the shortest line that takes part
SHORTEST = 20
#: of the query: the shortest line that takes part, and the shortest that one edit may set apart from a line that is no longer
EQUAL, NEAR = 1, 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def numbered_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """id, text_hash, no, line, size, and the line's 128-bit hash (h1, h2), of every line that takes part."""
    rows = docs.select(id_key().alias("id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    rows = rows.select("id", "text_hash", "no", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
    rows = rows.withColumn("size", F.char_length("line")).where(F.col("size") >= shortest)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def half_keys(lines: DataFrame) -> DataFrame:
    """Adds k0..k3: hashes of the first and the second half as a line of its length, and as one that is one longer than its partner."""
    n = F.col("size")
    out = {}
    for i, size in enumerate((n, n - 1)):
        half = F.floor(size / 2).cast("int")
        out[f"k{2 * i}"] = F.xxhash64(F.lit(0), size, F.substring("line", F.lit(1), half))
        out[f"k{2 * i + 1}"] = F.xxhash64(F.lit(1), size, F.substring("line", n - (size - half) + 1, size - half))
    return lines.withColumns(out)


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed variants of a line, and how each is made: 0 a character left out at its place, 1 the line itself, 2 one left out anywhere."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(points)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(points * powers(_BASE, n))])
    without = mix(total[:-1] + (total[-1] - total[1:]) * _BASE_INVERSE)
    placed = mix(without ^ mix(np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(n << 32)))
    shorter = np.unique(mix(without + np.uint64(n - 1)))
    itself = mix(mix(total[-1:]) + np.uint64(n))
    return np.concatenate([placed, itself, shorter]), np.repeat([0, 1, 2], [n, 1, len(shorter)])


def _variants(shared: Repeated | None, columns: list[str], near: int):
    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            held, size = [], 0
            for i, line in enumerate(rows["line"].tolist()):
                keys, kinds = variant_keys(line)
                if len(line) < near:  # it only meets longer lines, as it is
                    keys, kinds = keys[kinds == 1], kinds[kinds == 1]
                if shared is not None:
                    meet = shared(keys)
                    keys, kinds = keys[meet], kinds[meet]
                held.append((np.full(len(keys), i), keys, kinds))
                size += len(keys)
                if size > 500_000:
                    yield frame(rows, held)
                    held, size = [], 0
            if size:
                yield frame(rows, held)

    def frame(rows: pd.DataFrame, held: list) -> pd.DataFrame:
        at, keys, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
        out = {"key": keys.view(np.int64)}
        if columns:
            out |= {"kind": kinds.astype(np.int32)} | {c: rows[c].to_numpy()[at] for c in columns}
        return pd.DataFrame(out)

    return rows_of


def partners(docs: DataFrame, shortest: int = SHORTEST, near: int = SHORTEST) -> DataFrame:
    """h1, h2 of each line that has an earlier line within one edit, and where that one is first (p_id, p_no)."""
    spark = docs.sparkSession
    lines = half_keys(numbered_lines(docs, max(shortest, near - 1)))
    halves = ["k0", "k1", "k2", "k3"]
    distinct = lines.groupBy("h1", "h2").agg(*[F.min(k).alias(k) for k in halves])
    sketch = spark.sparkContext.broadcast(repeated(distinct.select(F.explode(F.array(*halves)))))

    @F.pandas_udf("boolean")
    def shares_half(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        test = sketch.value
        found = np.zeros(len(a), dtype=bool)
        for k in (a, b, c, d):
            found |= test(k.to_numpy(np.int64).view(np.uint64))
        return pd.Series(found)

    likely = lines.where(shares_half(*halves)).groupBy("h1", "h2")
    likely = likely.agg(F.first("line").alias("line"), F.min(F.struct("id", "no")).alias("at"), *[F.min(k).alias(k) for k in halves])
    likely = stored(likely.select("h1", "h2", "line", "at.*", *halves), "lines-likely")
    # what the sketch took for shared is counted exactly, so that the lines that go on grow with the input alone
    keys = likely.select("h1", "h2", F.explode(F.array(*halves)).alias("half"))
    met = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    sure = keys.join(met, "half", "left_semi").select("h1", "h2").distinct()
    likely = stored(likely.drop(*halves).join(sure, ["h1", "h2"], "left_semi"), "lines-sharing")
    shared = repeated(likely.select("line"), _variants(None, [], near))
    columns = ["h1", "h2", "id", "no"]
    variants = likely.mapInPandas(_variants(shared, columns, near), "key long, kind int, h1 long, h2 long, id long, no int")
    variants = stored(variants, "lines-variants")
    here = F.struct("id", "no", "h1", "h2")
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") != 2, here)).alias("short"), F.min(F.when(F.col("kind") != 1, here)).alias("long"),
        F.count("*").alias("n"),
    )
    met = met.where("n > 1 AND short IS NOT NULL AND long IS NOT NULL").withColumnRenamed("key", "met")
    paired = variants.join(met, F.col("key") == F.col("met"))
    other = F.when(F.col("kind") == 2, F.col("short")).otherwise(F.col("long"))
    best = paired.select("h1", "h2", here.alias("own"), other.alias("other")).where("other < own")
    best = best.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    texts = likely.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("text"))
    others = likely.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("other_text"))
    checked = best.join(texts, F.expr("h1 = a1 AND h2 = a2")).join(others, F.expr("other.h1 = b1 AND other.h2 = b2"))
    checked = checked.where(F.levenshtein("text", "other_text", 1) >= 0)
    return checked.select("h1", "h2", F.col("other.id").alias("p_id"), F.col("other.no").alias("p_no"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _flags(numbers: pd.Series) -> pd.Series:
    """A flag for each line number up to the largest."""
    out = []
    for some in numbers:
        flags = np.zeros(max(some) + 1, dtype=bool)
        flags[np.asarray(some)] = True
        out.append(flags)
    return pd.Series(out)


def removed_lines(docs: DataFrame, shortest: int = SHORTEST, near: int = SHORTEST) -> DataFrame:
    """id, text_hash, n_removed and, by line number, whether it goes, of every document that loses any line."""
    lines = numbered_lines(docs, shortest).select("id", "text_hash", "no", "h1", "h2")
    close = stored(partners(docs, shortest, near), "lines-partners")
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "no")).alias("own"), F.count("*").alias("n"))
    close = close.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.struct(F.col("p_id").alias("id"), F.col("p_no").alias("no")).alias("other"))
    first = first.join(close, F.expr("h1 = a1 AND h2 = a2"), "left").where("n > 1 OR other IS NOT NULL")
    first = first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.least("own", "other").alias("first"))
    gone = lines.join(first, F.expr("h1 = f1 AND h2 = f2")).where(F.struct("id", "no") > F.col("first"))
    numbers = gone.groupBy("id", "text_hash").agg(F.collect_set("no").alias("numbers"))
    return numbers.select("id", "text_hash", F.size("numbers").cast("long").alias("n_removed"), _flags("numbers").alias("gone"))


def deduped(docs: DataFrame, counts: bool = False, shortest: int = SHORTEST, near: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` with their remaining lines as text; ``counts`` adds n_lines and n_removed.

    Lines of ``shortest`` characters and more take part; of two that are one edit apart, the longer has ``near`` or more.
    """
    gone = removed_lines(docs, shortest, near).withColumnsRenamed({"id": "gone_id", "text_hash": "gone_hash"})
    joined = keyed_rows(docs).join(gone, F.expr("id = gone_id AND text_hash = gone_hash"), "left")
    before = F.col("row.text")
    lines = F.split(before, "\n")
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    text = F.when(F.col("n_removed").isNull(), before).otherwise(F.array_join(kept, "\n")).alias("text")
    out = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if counts:
        out.append(F.when(before.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"))
        out.append(F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))
    return joined.select(*out)


def op2_lines(spark, sf_dir: str) -> DataFrame:
    found = deduped(documents(spark, sf_dir).select("doc_id", "text"), True, EQUAL, NEAR)
    return found.select("doc_id", "n_lines", "n_removed", "text")
