"""Document chunks, TF-IDF vectors and nearest-chunk search."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.knn import nearest

CHUNK_CHARS = 500
OVERLAP_CHARS = 50
_SPLIT_ROWS = 64  # texts split at once
SEPARATORS = ["\n\n", "\n", " ", ""]


def chunk_stride(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Fixed windows of ``size`` characters, each repeating ``overlap``."""
    last = F.greatest(F.length("text") - overlap, F.lit(1))
    starts = F.sequence(F.lit(1), last, F.lit(size - overlap))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk", "start")).select(
        "doc_id", "chunk", F.substring("text", F.col("start"), F.lit(size)).alias("content")
    )


def _pieces(text: str, separators: list[str], size: int) -> Iterator[str]:
    """Cut at the coarsest separator present; cut longer pieces more finely.

    A separator stays at the head of the piece that follows it. Yields pieces
    no longer than ``size``; ``None`` closes a run that must not be merged on.
    """
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark = separators[level]
    if mark:
        head, *rest = text.split(mark)
        parts = [head, *[mark + r for r in rest]]
    else:
        parts = list(text)
    for part in parts:
        if len(part) < size:
            if part:
                yield part
        elif level + 1 < len(separators):
            yield None
            yield from _pieces(part, separators[level + 1 :], size)
            yield None
        else:
            yield None
            yield part
            yield None


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Pack pieces into chunks up to ``size``, carrying up to ``overlap`` over."""
    chunks: list[str] = []
    held: deque[str] = deque()
    total = 0

    def emit() -> None:
        joined = "".join(held).strip()
        if joined:
            chunks.append(joined)

    for piece in _pieces(text, SEPARATORS, size):
        if piece is None:
            if held:
                emit()
            held.clear()
            total = 0
            continue
        if held and total + len(piece) > size:
            emit()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if held:
        emit()
    return chunks


def chunk_recursive(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks along paragraph, line and word borders; other columns are kept."""

    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("chunk", T.IntegerType()), T.StructField("content", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _SPLIT_ROWS):
                texts = batch.column("text").slice(first, _SPLIT_ROWS).to_pylist()
                pieces = [split_text(t, size, overlap) if t else [] for t in texts]
                at = pa.array([first + i for i, p in enumerate(pieces) for _ in p], pa.int64())
                chunk = pa.array([n for p in pieces for n in range(len(p))], pa.int32())
                content = pa.array([c for p in pieces for c in p], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], chunk, content], names=schema.names)

    # a batch of texts is held as Arrow has it, and only a few of its rows as Python's strings
    return docs.select(*kept, "text").mapInArrow(split, schema)


def fit_tfidf(texts: DataFrame, column: str = "content", features: int = 256):
    """Hashed TF-IDF with unit vectors; fitting is one aggregate over the rows."""
    stages = [
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts)


def embed(model, texts: DataFrame) -> DataFrame:
    """Add ``vector``; works for chunks and questions alike."""
    out = model.transform(texts).withColumn("vector", vector_to_array("_unit"))
    return out.drop("_words", "_tf", "_idf", "_unit")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 3, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest chunks per question; inputs carry ``id`` and ``vector``."""
    return nearest(questions, chunks, k, metric)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: element-wise averages from one aggregation."""
    entries = vectors.select("label", F.posexplode("embedding").alias("position", "x"))
    means = entries.groupBy("label", "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "x")))
    return means.groupBy("label").agg(ordered.alias("e")).select(
        F.col("label").cast("long").alias("id"), F.transform("e", lambda e: e["x"]).alias("vector")
    )
