"""Count-min sketches of 64-bit values, reduced to what prefilters need: cells that were hit twice or more.

Each of ``DEPTH`` rows of the sketch has its own cells. A task sketches its partition as sorted cells per block of 2**16, each with a
count that stops at two; the partition sketches are merged per block, first in ``SALTS`` groups, then finally. A value is estimated
as repeated if its cell in every row was hit twice: counts are never underestimated, so no repeated value is lost, and what is
estimated too often only costs work in the exact pass that follows. The finished sketch is one bit per cell, 2**``BITS`` in all
(32 MB), at every size of the corpus; it is the only thing that passes through the driver. Beyond some hundred million values it
fills and lets more and more through; results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskweave.llm.text import mix

BITS = 28
DEPTH = 2
SALTS = 8
_FLUSH = 2_000_000
_SCHEMA = "block int, salt int, cells binary"


def cells(values: np.ndarray, row: int) -> np.ndarray:
    """The cell of each value in one row of the sketch."""
    width = BITS - (DEPTH - 1).bit_length()
    mixed = mix(values ^ np.uint64(0xA0761D6478BD642F * (row + 1) % (1 << 64)))
    return (mixed >> np.uint64(64 - width)) | np.uint64(row << width)


class Repeated:
    """Tests whether values are estimated to occur twice or more."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for row in range(DEPTH):
            cell = cells(values, row)
            out &= (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return out


def _at_most_twice(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted cells; one that occurs more than once is listed twice."""
    one, count = np.unique(np.concatenate(parts), return_counts=True)
    return np.repeat(one, np.minimum(count, 2))


def _partition_sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt = TaskContext.get().partitionId() % SALTS
    parts: list[np.ndarray] = []

    def rows() -> pd.DataFrame:
        all_cells = _at_most_twice(parts)
        block = (all_cells >> np.uint64(16)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low = (all_cells & np.uint64(0xFFFF)).astype("<u2")
        ends = np.append(first[1:], len(low))
        return pd.DataFrame(
            {
                "block": block[first].astype(np.int32), "salt": np.int32(salt),
                "cells": [low[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)],
            }
        )

    held = 0
    for frame in frames:
        values = frame.iloc[:, 0].to_numpy(np.int64).view(np.uint64)
        if not len(values):
            continue
        parts += [cells(values, row) for row in range(DEPTH)]
        held += DEPTH * len(values)
        if held >= _FLUSH:
            parts = [_at_most_twice(parts)]
            held = len(parts[0])
            if held >= _FLUSH:
                yield rows()
                parts, held = [], 0
    if parts:
        yield rows()


def _merge(final: bool):
    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        sizes: dict[int, int] = {}
        for frame in frames:
            for block, raw in zip(frame["block"].tolist(), frame["cells"].tolist(), strict=True):
                got = np.frombuffer(raw, dtype="<u2")
                held.setdefault(block, []).append(got)
                sizes[block] = sizes.get(block, 0) + len(got)
                if sizes[block] > 1 << 18:  # of 2**16 cells, each at most twice, half of this can stay
                    held[block] = [_at_most_twice(held[block])]
                    sizes[block] = len(held[block][0])
        blocks, raws = [], []
        for block, parts in held.items():
            listed = _at_most_twice(parts)
            if final:
                bits = np.zeros(1 << 16, dtype=bool)
                bits[listed[1:][listed[1:] == listed[:-1]]] = True
                if not bits.any():
                    continue
                raws.append(np.packbits(bits).tobytes())
            else:
                raws.append(listed.tobytes())
            blocks.append(block)
            if len(blocks) == 512:
                yield listed_rows(blocks, raws)
                blocks, raws = [], []
        if blocks:
            yield listed_rows(blocks, raws)

    def listed_rows(blocks: list[int], raws: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"block": np.array(blocks, dtype=np.int32), "salt": np.int32(0), "cells": raws})

    return merged


def repeated(values: DataFrame, keys: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> Repeated:
    """The merged sketch of a table of one long column, or of the column that ``keys`` makes of the table's batches.

    Both then run in one worker: two mapInPandas in a row would have twice as many, which stay with their memory.
    """
    sketched = values.mapInPandas(_partition_sketch if keys is None else lambda frames: _partition_sketch(keys(frames)), _SCHEMA)
    merged = sketched.repartition("block", "salt").mapInPandas(_merge(False), _SCHEMA)
    final = merged.repartition("block").mapInPandas(_merge(True), _SCHEMA)
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for row in final.select("block", "cells").toLocalIterator():
        bits[row["block"] << 13 : (row["block"] + 1) << 13] = np.frombuffer(row["cells"], dtype=np.uint8)
    return Repeated(bits)
