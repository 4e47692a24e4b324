"""Periodic run detection: squares caught over completed power-of-two blocks of words, merged into runs.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least ``EXPONENT`` times q
and ``SHORTEST`` words. It is found on the level of blocks of B = 2**l words with B <= q < 2 B. Whenever a block is complete it
gets a catcher, which waits for the block's words, and those of the block after it, to come again q words later. For a word t
there is one catcher on each level that can still be waiting: that of the last but one complete block. So every appended word
makes one suffix comparison per level, of a rolling hash of 2 B words with the catcher's own; a hit is a square of period q. All words of a
batch of texts make their comparison of a level at once, as numpy. A run of at least four periods holds such a block and its
recurrence, wherever it begins, so none is lost.

Hits of one period at neighbouring blocks belong to one run: they are merged, and the words of the merged hits and of the block on
either side are compared one by one, which gives the run's true borders (and leaves nothing to chance in the hashes). Levels go
upwards; a hit inside a stretch that a smaller period is known to fill has a multiple of that period (the periodicity lemma) and is
dropped before any comparison. Work is O(n log n) for n words, also for texts of nothing but one word.

Documents are independent of each other, so nothing is shuffled; a text of any length is one row's work.

A null or blank text has no words, hence no runs, and an empty collapsed text. A null doc_id is a row like any other. Repeated rows, or rows that share an
id, stay rows of their own. An empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents
from riskweave.llm.text import Words, batches, mix, powers

EXPONENT = 4
SHORTEST = 6

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of True of at least so many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    start, end = edge[0::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def runs_of(values: np.ndarray, longest: list[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """start, end, period of every run, by start, then period.

    ``longest``: per level, how many of ``values`` from the front on take part; what stands behind is too short for the level.
    """
    if exponent < 4:
        raise ValueError("blocks and their recurrence are only sure to lie in runs of four periods and more")
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    back = powers(_INVERSE, n + 1)
    ends_from = np.zeros(n + 1, dtype=np.int64)  # the furthest end of a known stretch that starts here
    found: set[tuple[int, int, int]] = set()
    for level, upto in enumerate(longest):
        block = 1 << level
        if upto < 3 * block + 1:
            break
        suffix = np.arange(block, upto - 2 * block + 1)  # the first of the last 2 B words
        waiting = (suffix // block - 1) * block
        at = slice(block, upto - 2 * block + 1)
        now = (total[3 * block : upto + 1] - total[at]) * back[at]
        own = np.arange(0, upto - 2 * block + 1, block)
        caught = (total[own + 2 * block] - total[own]) * back[own]
        hit = np.flatnonzero(now == caught[waiting // block])
        if not len(hit):
            continue
        start, period = waiting[hit], suffix[hit] - waiting[hit]
        known = np.maximum.accumulate(ends_from[:n])[start] >= start + period + 2 * block
        if known.all():
            continue
        start, period = start[~known], period[~known]
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        first = np.ones(len(start), dtype=bool)
        first[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] != block)
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(start)) - 1
        for a, b, q in zip(start[head].tolist(), start[tail].tolist(), period[head].tolist(), strict=True):
            low, high = max(0, a - block), min(upto - q, b + 3 * block)
            for i, j in zip(*_stretches(values[low:high] == values[low + q : high + q], 2 * block), strict=True):
                run = (low + int(i), low + int(j) + q, q)
                ends_from[run[0]] = max(ends_from[run[0]], run[1])
                found.add(run)
    kept = sorted((a, q, b) for a, b, q in found if b - a >= max(shortest, exponent * q))
    return np.array([(a, b, q) for a, q, b in kept], dtype=np.int64).reshape(-1, 3)


def _levels(sizes: np.ndarray, exponent: int) -> list[int]:
    """Per level, the length of the front of a row of texts, longest first and each with a mark behind it, that the level needs."""
    ends = np.cumsum(sizes + 1)
    out = []
    while len(sizes) and sizes[0] >= exponent << len(out):
        out.append(int(ends[np.searchsorted(-sizes, -(exponent << len(out)), side="right") - 1]))
    return out


Order = Callable[[int | None, int], "np.ndarray | None"]


def _rows(exponent: int, shortest: int, order_of: Order | None):
    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            texts, ids = rows["text"].tolist(), [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
            for low, high in batches(texts, 2_000_000):
                yield _batch(ids[low:high], texts[low:high], exponent, shortest, order_of)

    return rows_of


def _batch(ids: list, texts: list[str], exponent: int, shortest: int, order_of: Order | None) -> pd.DataFrame:
    words = Words(texts)
    counts = words.counts()
    at = np.arange(len(words.hash))
    if order_of:
        for i, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
            moved = order_of(doc_id, n) if n else None
            if moved is not None:
                at[words.first[i] : words.first[i + 1]] = words.first[i] + moved
    # the texts in a row, longest first, each with a mark of its own behind it, across which nothing can recur
    turn = np.argsort(-counts, kind="stable")
    sizes = counts[turn]
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    values = mix(np.arange(1, len(words.hash) + len(texts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    number = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values[np.repeat(begin, sizes) + number] = words.hash[at[np.repeat(words.first[turn], sizes) + number]]
    found = runs_of(values, _levels(sizes, exponent), exponent, shortest)
    of = np.searchsorted(begin, found[:, 0], side="right") - 1
    start = found[:, 0] - begin[of]
    length, period = found[:, 1] - found[:, 0], found[:, 2]
    gone = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(gone, words.first[turn[of]] + start + period, 1)
    np.add.at(gone, words.first[turn[of]] + start + length, -1)
    keep = np.cumsum(gone[:-1]) == 0
    listed: list[list[dict]] = [[] for _ in texts]
    for i, a, b, q in zip(turn[of].tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        listed[i].append({"start": a, "length": b, "period": q})
    strongest = [max(x, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if x else None for x in listed]
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"),
            "n_words": counts,
            "runs": listed,
            "strongest": strongest,
            "collapsed": _joined(words, at, keep),
        }
    )


def _joined(words: Words, at: np.ndarray, keep: np.ndarray) -> list[str]:
    """Per text, its kept words joined by single spaces."""
    kept = at[keep]
    doc = np.searchsorted(words.first, np.flatnonzero(keep), side="right") - 1
    sizes = words.end[kept] - words.start[kept] + 1
    ends = np.cumsum(sizes)
    take = np.repeat(words.start[kept] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    raw = np.frombuffer(words.buffer, dtype=np.uint8)[take] if len(take) else np.zeros(0, dtype=np.uint8)
    raw[ends - 1] = 0x20
    first = np.searchsorted(doc, np.arange(len(words.first)))
    bounds = np.concatenate([[0], ends])[first]
    whole = raw.tobytes()
    return [whole[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST, order_of: Order | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), the strongest run, and the text without what repeats, for every row of ``docs``.

    The strongest run has the greatest length / period, compared exactly; ties go to the smallest start, then period. In the collapsed
    text a word is left out if any run holds it after that run's first period; words are joined by single spaces. ``order_of`` may give, for
    an id and a number of words, the words' numbers in another order to be read in (None: as they stand).
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
    return slim.mapInPandas(_rows(exponent, shortest, order_of), schema)


def repeating_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of one document in ten, by the crc32 of its id, the words from some place on repeat what stands there. Without an id: as it is."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(documents(spark, sf_dir), order_of=repeating_tail)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
