"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizer runs once per distinct chunk: a text is cut before each blank or line end that follows other text, which is
always a border between the tokenizer's own words, so the ids of the chunks in a row are the ids of the text. Texts with
any other white space (two blanks, tabs, wide spaces) are handed to the tokenizer whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from riskweave.llm.common import give_back

#: distinct chunks that a worker remembers, those that it meets first, so the frequent ones; others are encoded again in each batch
REMEMBERED = 1_600_000
_ODD = re.compile(r"\s")


class Encoder:
    def __init__(self, path: str, end_id: int = 1):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.end_id = end_id
        self.code: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int32)
        self.n = 0
        self._add(np.array([self.end_id], dtype=np.uint32), np.ones(1, dtype=np.int64))  # code 0: the end of a document
        self.comma, self.stop = self._add_texts([",", "."])

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Codes for chunks whose ids stand in a row."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.n : self.n + len(sizes)] = sizes
        self.first[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.n += len(sizes)
        return range(self.n - len(sizes), self.n)

    def _add_texts(self, texts: list[str]) -> range:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return self._add(np.array([*itertools.chain.from_iterable(encoded)], dtype=np.uint32), sizes)

    def _in_a_row(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and where each chunk's ids end."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        take = np.repeat(self.first[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[take], ends

    def _learn(self, chunks: set[str]) -> None:
        """Codes for new chunks; -1 for one that shows that its text has to be encoded whole."""
        odd = [c for c in chunks if not c or c == "\n" or _ODD.search(c, 1) or (c[0] != "\n" and c[0].isspace())]
        self.code.update(dict.fromkeys(odd, -1))
        usual = chunks.difference(odd)
        # a comma or full stop after a letter is a word of its own
        pointed = [c for c in usual if c[-1] in ",." and c[-2:-1].isalpha()]
        plain = list(usual.difference(pointed).union(b for b in [c[:-1] for c in pointed] if b not in self.code))
        self.code.update(zip(plain, self._add_texts([c if c[0] == "\n" else " " + c for c in plain]), strict=True))
        if pointed:
            get = self.code.__getitem__
            pairs = [x for c in pointed for x in (get(c[:-1]), self.comma if c[-1] == "," else self.stop)]
            ids, ends = self._in_a_row(np.array(pairs))
            self.code.update(zip(pointed, self._add(ids, np.diff(ends[1::2], prepend=0)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text with the end id after it, and the number of ids of each."""
        split = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        # a text's first chunk has no blank before it: it is encoded by itself
        new = set().union(*(s[1:] for s in split)).difference(self.code)
        kept, kept_ids, known = self.n, self.used, len(self.code)
        if new:
            self._learn(new)
        if len(self.code) <= REMEMBERED:
            kept, kept_ids, known = self.n, self.used, len(self.code)
        get = self.code.__getitem__
        coded = [[*map(get, s[1:])] for s in split]
        whole = [i for i, (t, s) in enumerate(zip(texts, split, strict=True)) if t and (not s[0] or _ODD.search(s[0]) or -1 in coded[i])]
        skip = set(whole)
        heads = [i for i, t in enumerate(texts) if t and i not in skip]
        first = dict(zip(heads + whole, self._add_texts([split[i][0] for i in heads] + [texts[i] for i in whole]), strict=True))
        codes: list[int] = []
        bounds = []
        for i, rest in enumerate(coded):
            if i in first:
                codes.append(first[i])
            if i not in skip:
                codes += rest
            codes.append(0)
            bounds.append(len(codes) - 1)
        out, ends = self._in_a_row(np.array(codes))
        counts = np.diff(ends[bounds], prepend=0)
        # what belongs to single texts, or is too much, is not remembered
        self.n, self.used = kept, kept_ids
        while len(self.code) > known:
            self.code.popitem()
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The worker's encoder of a file: what one task has learnt serves the next ones.

    Called by name from this module; a dictionary that a task's function holds itself would come to every task anew and empty.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Frees what packing has left in a worker that goes on to other work: some hundred MB, of no use to that."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()
