"""Packing documents into windows of tokens by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. Whole windows are cut off first; the rest of a document, shorter than a window,
goes into a block of ``BLOCK`` documents. A block of total t needs m = ceil(t / window) windows. Each rest starts as a partial
partition of m sums, all but one of them zero; the two partial partitions with the largest spread are merged again and again,
the largest sums of one on the smallest of the other, until one partition is left, whose m sums are nearly equal. Where a sum
exceeds the window, m rises by one and the block is differenced anew, until all fit. Few large rests cannot be
balanced, so documents that may be cut (``cut``) go in as equal pieces of at most 1/``PARTS`` of a window, and a tenth of them as pieces of at most
1/``SMALL``; of every ``FINE``-th document that tenth is halved down to single tokens. Such pieces come last and level the sums to within a token or two, so m rises
only where the windows would be full to the last token; neighbouring pieces that meet in a window become one again.

Blocks are made from the rows that a task reads, so nothing is shuffled and no task holds more than one block; a lost task
is made anew from its input. Sequence ids count up within a task's partition, 2**33 for each.

A null or empty text is the end id alone. Repeated rows and rows sharing a doc_id are packed each for itself, and a null
doc_id stays null. A text of any length is cut into as many windows as it fills. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, give_back
from riskweave.llm.text import batches
from riskweave.llm.tokens import shared_encoder

WINDOW = 2048
BLOCK = 256
PARTS = 2
SMALL = 16
FINE = 3
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], ways: int) -> np.ndarray:
    """The way of each item in a partition into ``ways`` of nearly equal sums."""
    if ways <= 1 or not sizes:
        return np.zeros(len(sizes), dtype=np.int64)
    n = len(sizes)
    # a node is an item, a merge of two nodes, or 0 for nothing
    nodes = np.zeros(ways, dtype=np.int64)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes):
        sums, held = np.zeros(ways, dtype=np.int64), nodes.copy()
        sums[-1], held[-1] = size, i + 1
        heap.append((-size, i, sums, held))
    heapq.heapify(heap)
    merges: list[tuple[np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, others = sums + more[::-1], others[::-1]
        merged = n + 1 + ways * len(merges) + np.arange(ways)
        merges.append((held, others))
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), n + len(merges), sums, merged[order]))
    way = np.zeros(n + 1 + ways * len(merges), dtype=np.int64)
    way[heap[0][3]] = np.arange(ways)
    for k in range(len(merges) - 1, -1, -1):
        above = way[n + 1 + ways * k : n + 1 + ways * (k + 1)]
        way[merges[k][0]] = above
        way[merges[k][1]] = above
    return way[1 : n + 1]


def _cut(rest: int, window: int, fine: bool) -> list[int]:
    """Pieces of a rest: most of it in equal parts, the end in small ones, or in ever smaller ones down to single tokens."""
    small = max(1, window // SMALL)
    end = min(rest, max(small, rest // 10))
    out: list[int] = []
    for size, most in ((rest - end, max(1, window // PARTS)), (0 if fine else end, small)):
        count = -(-size // most)
        out += [size * (k + 1) // count - size * k // count for k in range(count)]
    while fine and end:
        out.append(max(1, end // 2))
        end -= out[-1]
    return out


def pack(sizes: list[int], window: int = WINDOW, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) that hold every token of the items once."""
    out = [[(i, k, window)] for i, size in enumerate(sizes) for k in range(0, size - window + 1, window)]
    pieces = []
    for i, size in enumerate(sizes):
        at = size - size % window
        for length in _cut(size % window, window, i % FINE == 0) if cut else [size % window]:
            pieces.append((i, at, length))
            at += length
    pieces = [p for p in pieces if p[2]]
    lengths = [length for _, _, length in pieces]
    ways = -(-sum(lengths) // window)
    while True:
        way = difference(lengths, ways)
        if not lengths or np.bincount(way, lengths, ways).max() <= window:
            break
        ways += 1
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(ways)]
    for piece, w in zip(pieces, way.tolist(), strict=True):
        last = filled[w][-1] if filled[w] else None
        if last and last[0] == piece[0] and last[1] + last[2] == piece[1]:
            filled[w][-1] = (last[0], last[1], last[2] + piece[2])
        else:
            filled[w].append(piece)
    return out + filled


def _packer(path: str, window: int, block: int, cut: bool):
    def rows(ids: list, counts: list[np.ndarray], tokens: list[np.ndarray], base: int) -> tuple[pd.DataFrame, int]:
        sizes = np.concatenate(counts)
        flat, at = np.concatenate(tokens), np.concatenate([[0], np.cumsum(sizes)])
        windows = pack(sizes.tolist(), window, cut)
        raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
        bounds = (4 * at).tolist()
        of, starts, lengths, sums, numbers, offsets = [], [], [], [], [], []
        for w, pieces in enumerate(windows, base):
            offset = 0
            for i, start, length in pieces:
                low = bounds[i] + 4 * start
                of.append(i)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(raw[low : low + 4 * length]))
                numbers.append(w)
                offsets.append(offset)
                offset += length
        keys = pd.array(ids, dtype="Int64")
        frame = pd.DataFrame(
            {
                "doc_id": keys.take(of), "start": starts, "length": lengths, "ids_crc32": sums, "doc_tokens": sizes[of],
                "sequence_id": numbers, "offset": offsets,
            }
        )
        return frame, len(windows)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(path)
        base = TaskContext.get().partitionId() << 33
        ids: list = []
        counts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        for frame in frames:
            keys, texts = frame["doc_id"].astype("Int64").tolist(), frame["text"].fillna("").tolist()
            for low, high in batches(texts):
                for k in range(low, high, block):
                    upto = min(high, k + block)
                    flat, sizes = encoder.encode(texts[k:upto])
                    ids += keys[k:upto]
                    counts.append(sizes)
                    tokens.append(flat)
                    if len(ids) >= block or sum(map(len, tokens)) >= block * window:
                        out, used = rows(ids, counts, tokens, base)
                        yield out
                        base, ids, counts, tokens = base + used, [], [], []
        if ids:
            yield rows(ids, counts, tokens, base)[0]
        del ids, counts, tokens
        give_back()

    return packed


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block: int = BLOCK, cut: bool = True) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text), with its place in a window."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(_packer(tokenizer_path, window, block, cut), SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
