"""Substring dedup: windows of ``WINDOW`` words that start earlier elsewhere, found exactly behind a count-min prefilter.

A word goes if it lies in a window whose words also start earlier: in a document with a smaller doc_id, or earlier in the same one.
Windows are judged on the input, not on what is left. Repeats inside a document are found where its text is read; between
documents only the smallest doc_id of each window matters, so the exact pass groups rows of (window hash, doc_id), with a
combining minimum before the shuffle, and joins the minima back. A window that a third of all documents hold is one row per task
in the grouping, and Spark splits it in the join.

Few windows get that far. Each window has an anchor, the smallest hash of the ``GRAM``-word grams in it; equal windows have
equal anchors, and neighbouring windows mostly the same one, so there are some six times fewer anchors than words. A count-min sketch of all
anchors, merged from the tasks' sketches (``counts``), overestimates in how many places an anchor stands and so how often any of its
windows does; only windows estimated repeated are grouped, and no repeated window is lost. Equal texts are found first, the same way, by
their hash: of each group the one with the smallest doc_id stands for all, and the others lose all words that lie in any window.

Windows are compared by 64-bit hashes of their words' 64-bit hashes.

A null or blank text has no words; texts of fewer than ``WINDOW`` words lose none. Rows that share a doc_id, or repeat, count as the same
place between documents: neither is earlier than the other. A null doc_id comes first. An empty table gives an empty result; other
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import NULL_ID, documents, id_key, stored
from riskweave.llm.counts import Repeated, repeated
from riskweave.llm.text import Words, batches

WINDOW = 20
GRAM = 10
_NEVER = np.uint64(2**64 - 1)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of ``values[i : i + width]``, for every i with that many."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        done += step
    return at


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of every window, the index of its anchor, and all gram hashes."""
    starts, hashes = words.windows(WINDOW)
    grams = np.full(len(words.hash), _NEVER)
    at, values = words.windows(GRAM)
    grams[at] = values
    where = sliding_argmin(grams, WINDOW - GRAM + 1)[starts] if len(starts) else starts
    return starts, hashes, where, grams


def _texts(frames: Iterator[pd.DataFrame], often: Repeated) -> Iterator[tuple[np.ndarray, Words]]:
    """The ids and words of texts that are unique or first of their kind."""
    for rows in frames:
        rows = rows[rows["first"].to_numpy(bool) | ~often(rows["text_hash"].to_numpy(np.int64).view(np.uint64))]
        ids, texts = rows["id"].to_numpy(np.int64), rows["text"].tolist()
        for low, high in batches(texts):
            yield ids[low:high], Words(texts[low:high])


def _anchor_rows(frames: Iterator[pd.DataFrame], often: Repeated) -> Iterator[pd.DataFrame]:
    for _, words in _texts(frames, often):
        _, _, where, grams = anchors(words)
        fresh = np.ones(len(where), dtype=bool)
        fresh[1:] = where[1:] != where[:-1]
        yield pd.DataFrame({"anchor": grams[where[fresh]].view(np.int64)})


def _window_rows(test: Repeated, often: Repeated):
    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, words in _texts(frames, often):
            starts, hashes, where, grams = anchors(words)
            fresh = np.ones(len(where), dtype=bool)
            fresh[1:] = where[1:] != where[:-1]
            likely = test(grams[where[fresh]])[np.cumsum(fresh) - 1] if len(where) else fresh
            hashes, doc = hashes[likely], words.doc[starts[likely]]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            once = np.ones(len(doc), dtype=bool)
            once[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            yield pd.DataFrame({"window": hashes[once].view(np.int64), "id": ids[doc[once]]})

    return rows_of


def _removed_rows(frames: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for rows in frames:
        texts = rows["text"].tolist()
        for low, high in batches(texts):
            part, words = rows.iloc[low:high], Words(texts[low:high])
            starts, hashes = words.windows(WINDOW)
            n, late = words.counts(), np.zeros(len(starts), dtype=bool)
            bounds = np.searchsorted(starts, words.first)
            joined, begin, end = words.joined()
            kept = []
            for i, (earlier, copied) in enumerate(zip(part["earlier"], part["copied"], strict=True)):
                a, b = bounds[i], bounds[i + 1]
                own = hashes[a:b]
                if copied:
                    late[a:b] = True
                else:
                    late[a:b] = True
                    late[a + np.unique(own, return_index=True)[1]] = False
                    if earlier is not None and len(earlier):
                        late[a:b] |= np.isin(own, np.asarray(earlier, dtype=np.int64).view(np.uint64))
            edges = np.zeros(len(words.hash) + 1, dtype=np.int64)
            np.add.at(edges, starts[late], 1)
            np.add.at(edges, starts[late] + WINDOW, -1)
            gone = np.cumsum(edges[:-1]) > 0
            for i in range(len(part)):
                a, b = words.first[i], words.first[i + 1]
                if not gone[a:b].any():
                    kept.append(joined[begin[a] : end[b - 1]] if b > a else b"")
                else:
                    kept.append(b" ".join([joined[s:e] for s, e in zip(begin[a:b][~gone[a:b]], end[a:b][~gone[a:b]], strict=True)]))
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None if k == NULL_ID else k for k in part["id"]], dtype="Int64"),
                    "n_words": n, "n_removed": removed[words.first[1:]] - removed[words.first[:-1]],
                    "kept": [k.decode("utf-8", "surrogatepass") if with_text else None for k in kept],
                    "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                }
            )


def removed_words(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words joined by blanks, and their hash, of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(id_key().alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = spark.sparkContext.broadcast(repeated(base.select("text_hash")))

    @F.pandas_udf("boolean")
    def often(text_hash: pd.Series) -> pd.Series:
        return pd.Series(sketch.value(text_hash.to_numpy(np.int64).view(np.uint64)))

    copies = base.where(often("text_hash")).withColumn("second", F.xxhash64(F.lit(1), "text"))
    firsts = copies.groupBy("text_hash", "second").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    firsts = stored(firsts, "substring-firsts")
    # the tasks leave out the other texts of a group themselves, which spares them a second Python worker
    columns = ["id", "text", "text_hash", "first"]
    unique = base.withColumn("first", F.lit(False)).select(*columns)
    unique = unique.unionByName(firsts.withColumn("first", F.lit(True)).select(*columns))
    test = repeated(unique, lambda frames: _anchor_rows(frames, sketch.value))
    held = spark.sparkContext.broadcast(test)
    windows = unique.mapInPandas(lambda frames: _window_rows(held.value, sketch.value)(frames), "window long, id long")
    lowest = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    later = windows.join(lowest.select(F.col("window").alias("w"), "low"), F.expr("window = w AND id > low"))
    later = later.groupBy("id").agg(F.collect_list("window").alias("earlier"))
    small = firsts.select(F.col("text_hash").alias("h"), F.col("second").alias("s"), F.col("id").alias("first"))
    copied = copies.select("id", "text_hash", "second").join(small, F.expr("text_hash = h AND second = s AND id > first"))
    copied = copied.groupBy("id").agg(F.collect_set("text_hash").alias("copies")).withColumnRenamed("id", "copy_id")
    known = later.join(copied, F.expr("id = copy_id"), "full").select(F.coalesce("id", "copy_id").alias("known"), "earlier", "copies")
    rows = base.join(known, F.expr("id = known"), "left")
    rows = rows.select("id", "text", "earlier", F.coalesce(F.array_contains("copies", F.col("text_hash")), F.lit(False)).alias("copied"))
    out = rows.mapInPandas(lambda frames: _removed_rows(frames, with_text), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out if with_text else out.drop("kept")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir), with_text=False)
