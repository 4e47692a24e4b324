"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps the hash of every distinct shingle of ``SHINGLE`` words that lies below a fixed fraction of the hash range, and the
``FEW`` smallest whatever they are, so that a short text has a sketch too. Which hashes stay does not depend on the text's
length: the sketch of two texts together comes from the union of theirs, and the share of one sketch found in the other, up to
the hash up to which both are complete, estimates how much of one text is contained in the other, also when one is a thousand
times longer. That containment is the ``likeness`` of a text to another. The sketch of a text of few shingles may have no hash up to where
that of a long one is complete; from the two sketches alone the likeness is then unknown (NaN).

The query compares each document with its successor by doc_id, whose text the task has in hand: the sketch of the one is looked up in
all shingles of the other (``contained``), so a short text is compared whole with a long one. Documents are shuffled once, by ranges of doc_id whose bounds
come from quantiles over all ids; the first document of a range also goes to the range before it, that of the first range to the
last. A task streams over its range in order and holds one batch.

A null or empty text has an empty sketch, which is like another empty one (1) and unlike all others (0). A text of fewer than
``SHINGLE`` words is one shingle. Rows that share a doc_id, or have none (these come first), follow each other by the hash of their
text; repeated rows are documents of their own. An empty table gives an empty result; a single document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import NULL_ID, documents, id_key
from riskweave.llm.text import Words, batches

SHINGLE = 5
FRACTION = 8  # one in so many hashes stays
FEW = 16
_LIMIT = np.uint64((1 << 48) // FRACTION)


def shingles(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 48-bit hashes of all shingles of each text."""
    out: list[np.ndarray] = []
    for low, high in batches(texts):
        words = Words(texts[low:high])
        starts, hashes = words.windows(shingle, short=True)
        hashes, doc = hashes >> np.uint64(16), words.doc[starts]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, doc = hashes[fresh], doc[fresh]
        bounds = np.searchsorted(doc, np.arange(high - low + 1))
        out += [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def _kept(hashes: np.ndarray) -> np.ndarray:
    """Of sorted hashes, those that a sketch keeps."""
    return hashes[: max(FEW, int(np.searchsorted(hashes, _LIMIT)))]


def sketches(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 48-bit hashes of each text's sketch."""
    return [_kept(x) for x in shingles(texts, shingle)]


def merged(*parts: np.ndarray) -> np.ndarray:
    """The sketch of all the texts together."""
    return _kept(np.unique(np.concatenate(parts)))


def _complete_to(sketch: np.ndarray) -> np.uint64:
    """Up to this hash a sketch has all of its text."""
    return np.uint64(1 << 48) if len(sketch) < FEW else max(_LIMIT, sketch[-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles behind ``a`` that are also behind ``b``; NaN where the sketches have no hash to tell it by."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a = a[a <= min(_complete_to(a), _complete_to(b))]
    return contained(a, b) if len(a) else float("nan")


def contained(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles behind the sketch ``a`` that are among the shingles ``b``, all of a text."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(np.count_nonzero(b[at] == a) / len(a))


def encoded(sketch: np.ndarray) -> str:
    """As text: six bytes a hash, base64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode("ascii")


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def with_successor_ranges(docs: DataFrame) -> DataFrame:
    """key, ghost, text_hash, doc_id, text in partitions that are ranges of the key, in order.

    After its own rows a range has the first row of the next range, as a ghost; the last range has that of the first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(id_key().alias("key"))
    cuts = keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)
    # quantiles are doubles: as cuts they only need to be the same everywhere
    bounds = np.unique(np.array(cuts, dtype=float))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype=float), side="right").astype(np.int32))

    lows = keys.groupBy(range_of("key").alias("part")).agg(F.min("key").alias("low")).orderBy("part").collect()
    order = [r["part"] for r in lows]
    before = {r["low"]: order[i - 1] for i, r in enumerate(lows)}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(dtype=float), side="right").tolist()
        return pd.Series([[p, before[k]] if k in before else [p] for p, k in zip(own, key.tolist(), strict=True)])

    slim = docs.select(id_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = slim.select("*", F.posexplode(places("key")).alias("ghost", "part"))
    return (
        placed.repartitionById(parts, "part")
        .select("ghost", "key", F.xxhash64("text").alias("text_hash"), "doc_id", "text")
        .sortWithinPartitions("ghost", "key", "text_hash")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str]) -> pd.DataFrame:
    """Each text but the last with the one after it."""
    edited = []
    for text, after in zip(texts[:-1], texts[1:], strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    whole, changed = shingles(texts), shingles(edited)
    own = [_kept(x) for x in whole[:-1]]
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"),
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": [encoded(s) for s in own],
            "edited_fingerprint": [encoded(_kept(x)) for x in changed],
            "near_edited": [contained(a, b) for a, b in zip(own, changed, strict=True)],
            "near_next": [contained(a, b) for a, b in zip(own, whole[1:], strict=True)],
        }
    )


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: list = []
    texts: list[str] = []
    done = False
    for rows in frames:
        for low, high in batches(rows["text"].tolist()):
            part = rows.iloc[low:high]
            own = int((part["ghost"] == 0).sum())
            take = min(len(part), own + 1)  # of the ghosts only the first
            if done:
                continue
            ids += [None if k == NULL_ID else i for k, i in zip(part["key"][:own], part["doc_id"][:own], strict=True)]
            texts += part["text"][:take].tolist()
            done = take > own
            if len(texts) > 1:
                n = len(texts) - 1
                yield _compare(ids[:n], texts)
                ids, texts = ids[n:], texts[n:]


def successive(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how like it is to that and to the next document."""
    return with_successor_ranges(docs).mapInPandas(_stream, SCHEMA)


def op5_sketch(spark, sf_dir: str) -> DataFrame:
    return successive(documents(spark, sf_dir))
