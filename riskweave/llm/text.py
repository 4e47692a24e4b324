"""Words, windows and hashes of whole texts, as numpy over batches of documents.

A word is a maximal run of characters other than ASCII white space. Hashes are polynomial over 64 bits and mixed; all of
a batch is hashed at once, so no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ``[^\x20\x09-\x0D]+`` for Spark's regular expressions
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_BYTE_INVERSE = np.uint64(pow(int(_BYTE), -1, 1 << 64))
_WORD_INVERSE = np.uint64(pow(int(_WORD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _spans_hash(values: np.ndarray, base: np.uint64, inverse: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every span, independent of where the span stands."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts])


class Words:
    """The words of a batch of texts.

    ``hash``   64-bit hash of each word, in text order
    ``doc``    index of the text that holds it
    ``first``  index of each text's first word; one more entry at the end
    ``start``, ``end``  byte span in ``buffer``
    """

    def __init__(self, texts: list[str], lower: bool = False):
        """``lower``: A-Z count as a-z."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = b"\n".join(parts) + b"\n"
        if lower:
            self.buffer = self.buffer.lower()  # of bytes: only A-Z change
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = _spans_hash(raw.astype(np.uint64) + np.uint64(1), _BYTE, _BYTE_INVERSE, self.start, self.end)
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])  # byte at which each text begins
        self.first = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bare_hash(self, stem: int | None = None) -> np.ndarray:
        """Hash of each word without ASCII punctuation before and after it; a word of nothing else counts as it is.

        ``stem``: of its first so many bytes only.
        """
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        start, end = self.start.copy(), self.end.copy()
        edge = np.flatnonzero(_MARK[raw[start]]) if len(start) else np.zeros(0, dtype=np.int64)
        while len(edge):
            start[edge] += 1
            edge = edge[(start[edge] < end[edge]) & _MARK[raw[np.minimum(start[edge], len(raw) - 1)]]]
        edge = np.flatnonzero((start < end) & _MARK[raw[end - 1]]) if len(start) else np.zeros(0, dtype=np.int64)
        while len(edge):
            end[edge] -= 1
            edge = edge[_MARK[raw[end[edge] - 1]] & (start[edge] < end[edge])]
        blank = start >= end
        start[blank], end[blank] = self.start[blank], self.end[blank]
        if stem is not None:
            end = np.minimum(end, start + stem)
        return _spans_hash(raw.astype(np.uint64) + np.uint64(1), _BYTE, _BYTE_INVERSE, start, end)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by single spaces, and the span of each word in that."""
        sizes = self.end - self.start + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        take = np.repeat(self.start - starts, sizes) + np.arange(ends[-1] if len(ends) else 0)
        out = np.frombuffer(self.buffer, dtype=np.uint8)[take]
        out[ends - 1] = 0x20
        return out.tobytes(), starts, ends - 1

    def windows(self, length: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and hash of every window of ``length`` words inside one text.

        ``short``: a text of fewer words, but at least one, gives one window of all its words.
        """
        starts, stops = self.window_spans(length, short)
        return starts, _spans_hash(self.hash, _WORD, _WORD_INVERSE, starts, stops)

    def window_spans(self, length: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and end (a word index) of the same windows."""
        ends = self.first[1:][self.doc]
        at = np.arange(len(self.hash))
        starts = at[at + length <= ends]
        stops = starts + length
        if short:
            small = np.flatnonzero((self.counts() > 0) & (self.counts() < length))
            starts = np.concatenate([starts, self.first[small]])
            stops = np.concatenate([stops, self.first[small + 1]])
            order = np.argsort(starts, kind="stable")
            starts, stops = starts[order], stops[order]
        return starts, stops


def batches(texts: list[str], characters: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters; a longer text is a range of its own."""
    low, total = 0, 0
    for i, text in enumerate(texts):
        if i > low and total + len(text) > characters:
            yield low, i
            low, total = i, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)
