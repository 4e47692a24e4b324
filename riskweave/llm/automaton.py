"""Language-model scoring by a weighted backoff automaton: smoothed n-grams become states with failure arcs.

A state is a history of up to ``ORDER`` - 1 tokens that the training documents hold. An arc reads a token that they hold after that
history, weighs log10 of its smoothed probability, and leads to the longest history that it ends in. Where a state has no arc for the token,
the failure arc leads to the history without its first token, at the log10 of the share that is left to shorter histories; the empty
history reads any token. One traversal from left to right carries the state and adds the weights. Probabilities are Dirichlet-smoothed:

    p(w | h) = (c(hw) + m * p(w | h without its first token)) / (c(h) + m),    m = ``PRIOR`` of the length of h,

on top of p(w) = (c(w) + 1) / (N + V + 1), where one share is that of all unknown words, so that they sum to one after every history.

The model has every n-gram of the training documents, without cut-offs, and grows with the corpus; no task holds more than a share of it.

1. Documents are cut into blocks of some ``BLOCK`` words, which are written once as rows: ids, local word codes, distinct words.
2. Each block lists its distinct n-grams of all orders as 64-bit hashes, with their counts in its training documents. The hash space is cut into
   equal ranges, as many as the corpus has words for, and the sorted hashes of a block that fall into a range are one packed row. A very
   frequent n-gram is one entry per block, so no range is much larger than another.
3. Each range adds up the counts and answers every block, entry by entry.
4. Each block joins its answers, builds the automaton of its own n-grams (all that its texts can touch), and traverses its texts. They are
   traversed side by side in lanes; a long text is cut into lanes of ``LANE`` tokens, which begin in the state that the two tokens
   before them lead to, the same as a traversal from the beginning would carry there.

N-grams are told apart by their order and a hash of as many bits as the corpus asks for: ``SPARE`` more than it takes to number all of them (62 at
most), so that one gram in 2**``SPARE`` shares its hash with another.

A null text is empty: it has the end token only. A null doc_id counts as empty text for the split. Repeated rows, or rows that share
an id, are rows of their own, and train as often as they stand. With no training documents every token is unknown (log10 1 = 0). An empty
table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, stored
from riskweave.llm.text import Words, mix

ORDER = 3
#: weight of the shorter history, in words, after histories of one and two tokens
PRIOR = (1000.0, 10.0)
#: words of a block; a longer text is a block of its own
BLOCK = 1_500_000
#: entries of a range of hashes, on average
RANGE = 2_000_000
LANE = 512
SPARE = 26

_BEGIN, _END = np.uint64(1), np.uint64(2)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ORDER = np.uint64(3)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of bytes."""
    raw = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")))
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


# --- blocks -----------------------------------------------------------------------------------------------------------


class Block:
    """Documents as token codes. ``words``: hash of each code; ``codes``: every document's words, then the end token."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.words, self.codes, self.sizes, self.train = words, codes, sizes, train

    def listed(self, order: int, bits: int = 62) -> Listed:
        return Listed(self, order, bits)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where one of each stands, and which each key is."""
    turn = np.argsort(keys)
    ranked = keys[turn]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(keys), dtype=np.int32)
    which[turn] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], turn[new].astype(np.int32), which


class Listed:
    """The distinct grams of a block: per order, which gram ends at each place, and a place that shows each gram.

    A place stands for every token, and one more in front of every document for its beginning, which is a gram of order one only.
    """

    def __init__(self, block: Block, order: int, bits: int):
        shift = np.uint64(64 - bits)
        sizes = block.sizes + 1
        ends = np.cumsum(sizes)
        begin = ends - sizes
        token = np.ones(int(sizes.sum()), dtype=bool)
        token[begin] = False
        symbols = np.full(len(token), _BEGIN, dtype=np.uint64)
        symbols[token] = block.words[block.codes]
        self.depth = (np.arange(len(token)) - np.repeat(begin, sizes)).astype(np.int32)
        train = np.repeat(block.train, sizes)
        self.at, self.shown, self.distinct, self.trained = [], [], [], []
        hashes = symbols
        for n in range(1, order + 1):
            places = np.flatnonzero(self.depth >= n - 1).astype(np.int32)
            if n > 1:
                longer = np.zeros(len(token), dtype=np.uint64)
                longer[places] = mix(hashes[places - 1] * _STEP + symbols[places] + np.uint64(n))
                hashes = longer
            distinct, shown, which = _distinct(((mix(hashes[places] + np.uint64(n)) >> shift) << np.uint64(2)) | np.uint64(n))
            at = np.full(len(token), -1, dtype=np.int32)
            at[places] = which
            self.at.append(at)
            self.shown.append(places[shown])
            self.distinct.append(distinct)
            self.trained.append(np.bincount(which[train[places]], minlength=len(distinct)).astype(np.uint32))
        every = np.concatenate(self.distinct)
        self.order = np.argsort(every, kind="stable").astype(np.int32)
        self.keys = every[self.order]

    def counts(self) -> np.ndarray:
        return np.concatenate(self.trained)[self.order]

    def by_order(self, answers: np.ndarray) -> list[np.ndarray]:
        """Counts in the order of ``keys`` as one array per order of grams. The keys are no longer needed then, and go."""
        out = np.zeros(len(answers), dtype=np.int64)
        out[self.order] = answers
        sizes = [len(x) for x in self.distinct]
        del self.order, self.keys, self.distinct, self.trained
        return np.split(out, np.cumsum(sizes)[:-1])


_BLOCK_SCHEMA = "block long, n_docs long, n_train long, n_tokens long, n_train_tokens long, ids binary, known binary, train binary, sizes binary, words binary, codes binary"


def _block_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    made = 0
    held: list[tuple] = []
    size = 0

    def row() -> pd.DataFrame:
        nonlocal made, held, size
        ids = np.concatenate([x[0] for x in held])
        known = np.concatenate([x[1] for x in held])
        train = np.concatenate([x[2] for x in held])
        sizes = np.concatenate([x[3] for x in held])
        hashes = np.concatenate([x[4] for x in held])
        distinct, _, codes = _distinct(hashes)
        turn = np.argsort(-np.bincount(codes), kind="stable")  # small codes for frequent words
        rank = np.empty(len(turn), dtype=np.uint32)
        rank[turn] = np.arange(len(turn), dtype=np.uint32)
        out = {
            "block": (part << 32) | made, "n_docs": len(ids), "n_train": int(train.sum()), "n_tokens": int(sizes.sum()), "n_train_tokens": int(sizes[train].sum()),
            "ids": pack(ids), "known": pack(known.astype(np.uint8)), "train": pack(train.astype(np.uint8)), "sizes": pack(sizes), "words": pack(distinct[turn]), "codes": pack(rank[codes]),
        }
        made, held, size = made + 1, [], 0
        return pd.DataFrame([out])

    for rows in frames:
        texts = rows["text"].tolist()
        low = 0
        while low < len(texts):
            high, characters = low, 0
            while high < len(texts) and (high == low or characters + len(texts[high]) < 4_000_000):
                characters += len(texts[high])
                high += 1
            words = Words(texts[low:high], lower=True)
            sizes = words.counts() + 1
            ends = np.cumsum(sizes)
            tokens = np.full(int(ends[-1]), _END, dtype=np.uint64)
            inside = np.ones(len(tokens), dtype=bool)
            inside[ends - 1] = False
            tokens[inside] = words.hash
            if held and size + len(tokens) > BLOCK:
                yield row()
            part_of = rows.iloc[low:high]
            known = part_of["doc_id"].notna().to_numpy()
            held.append((part_of["doc_id"].fillna(0).to_numpy(np.int64), known, part_of["train"].to_numpy(bool), sizes.astype(np.int64), tokens))
            size += len(tokens)
            low = high
    if held:
        yield row()


def blocks_of(docs: DataFrame, train: Column) -> DataFrame:
    """The documents as rows of packed blocks; ``train`` says which documents the model learns from."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return stored(slim.mapInPandas(_block_rows, _BLOCK_SCHEMA), "automaton-blocks")


def _block(row) -> Block:
    return Block(unpack(row.words, np.uint64), unpack(row.codes, np.uint32), unpack(row.sizes, np.int64), unpack(row.train, np.uint8).astype(bool))


# --- counts -----------------------------------------------------------------------------------------------------------


def _request_rows(frames: Iterator[pd.DataFrame], order: int, ranges: int, bits: int) -> Iterator[pd.DataFrame]:
    width = np.uint64((1 << bits + 2) // ranges + 1)
    for rows in frames:
        for row in rows.itertuples(index=False):
            listed = _block(row).listed(order, bits)
            counts = listed.counts()
            number = (listed.keys // width).astype(np.int64)
            cut = np.flatnonzero(np.diff(number, prepend=-1))
            for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(number)], strict=True):
                yield pd.DataFrame(
                    {"part": [int(number[low])], "block": [row.block], "keys": [_pack_sorted(listed.keys[low:high])], "counts": [pack(counts[low:high])]}
                )


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The whole counts of one range of hashes for every block that asks; fresh: distinct words among them that training documents hold."""
    rows = rows.sort_values("block")
    keys = [_unpack_sorted(x) for x in rows["keys"]]
    sizes = np.array([len(x) for x in keys])
    every = np.concatenate(keys)
    own = np.concatenate([unpack(x, np.uint32) for x in rows["counts"]])
    distinct, _, which = _distinct(every)
    total = np.bincount(which, own, len(distinct)).astype(np.uint64)
    ends = np.cumsum(sizes)
    fresh = np.zeros(len(rows), dtype=np.int64)
    fresh[0] = int((((distinct & _ORDER) == np.uint64(1)) & (total > 0)).sum())
    whole = [pack(total[which[a:b]]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame({"part": rows["part"].to_numpy(), "block": rows["block"].to_numpy(), "counts": whole, "fresh": fresh})


def answers_of(blocks: DataFrame, order: int, ranges: int, bits: int) -> DataFrame:
    """part, block, counts: the training count in all documents of every distinct gram of a block, range by range."""
    asked = blocks.mapInPandas(lambda frames: _request_rows(frames, order, ranges, bits), "part long, block long, keys binary, counts binary")
    given = asked.groupBy("part").applyInPandas(_answer, "part long, block long, counts binary, fresh long")
    return stored(given, "automaton-counts")


# --- the automaton ----------------------------------------------------------------------------------------------------


class Automaton:
    """States, arcs and failure arcs of the grams of one block.

    State 0 is the empty history; then come the histories of one token, then of two, and so on. The arc that reads a token after a history of n tokens
    is numbered like the gram of n + 1 tokens that it completes, so no arc has to be searched for in a text of the block: ``weight`` and ``leads`` are
    lists by n, with ``has`` for those that exist. ``fails``, ``fail_weight`` and ``length`` belong to states.
    """

    def __init__(self, listed: Listed, counts: list[np.ndarray], tokens: int, words: int, prior: tuple[float, ...] = PRIOR):
        """``counts``: training counts of ``listed``'s grams per order; that of the beginning is the number of training documents.
        ``tokens`` and ``words``: N and V of the training documents."""
        self.listed, self.longest = listed, len(counts) - 1
        self.unknown = float(np.log10(1.0 / (tokens + words + 1.0)))
        self.has, self.weight, self.leads, self.state_of = [], [], [], []
        fails, fail_weight, length = [np.zeros(1, dtype=np.int32)], [np.zeros(1)], [np.zeros(1, dtype=np.int8)]
        states, probability = 1, np.zeros(0)
        number = np.int32 if sum(map(len, counts)) < 2**31 else np.int64
        for n, (count, shown) in enumerate(zip(counts, listed.shown, strict=True), 1):
            held = count > 0
            if n == 1:
                probability = (count + 1.0) / (tokens + words + 1.0)
            else:
                before, after, m = listed.at[n - 2][shown - 1], listed.at[n - 2][shown], prior[n - 2]
                probability = (count + m * probability[after]) / (counts[n - 2][before] + m)
            state = np.zeros(len(count), dtype=number)
            shorter = np.zeros(len(count), dtype=number) if n == 1 else self.state_of[n - 2][listed.at[n - 2][shown]]
            if n <= self.longest:
                state[held] = states + np.arange(int(held.sum()))
                states += int(held.sum())
                fails.append(shorter[held])
                fail_weight.append(np.log10(prior[n - 1] / (count[held] + prior[n - 1])))
                length.append(np.full(int(held.sum()), n, dtype=np.int8))
            self.state_of.append(state)
            self.has.append(held)
            self.weight.append(np.log10(probability))
            # the longest grams lead to the history without their first token, which is held since they are
            self.leads.append(state if n <= self.longest else shorter)
        self.fails, self.fail_weight, self.length = np.concatenate(fails), np.concatenate(fail_weight), np.concatenate(length)

    def begin(self, places: np.ndarray) -> np.ndarray:
        """The state before the tokens at ``places``: the longest history that ends there and is a state."""
        out = np.zeros(len(places), dtype=np.int64)
        for n in range(1, self.longest + 1):
            at = self.listed.at[n - 1][places - 1]
            state = np.where(at >= 0, self.state_of[n - 1][at], 0)
            out = np.where(state > 0, state, out)
        return out

    def read(self, state: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of reading the tokens at ``places`` in these states, failure arcs included, and the states after them."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        waiting = np.arange(len(state))
        for n in range(self.longest, -1, -1):
            here = self.length[state] == n  # a failure arc leads to a history one token shorter, so those of n are all there by now
            arc = self.listed.at[n][places[waiting[here]]]
            hit = np.zeros(len(waiting), dtype=bool)
            hit[here] = self.has[n][arc]
            arc = arc[self.has[n][arc]]
            weight[waiting[hit]] += self.weight[n][arc]
            after[waiting[hit]] = self.leads[n][arc]
            lost = here & ~hit
            weight[waiting[lost]] += self.fail_weight[state[lost]] if n else self.unknown
            state = np.where(lost, self.fails[state], state)[~hit]
            waiting = waiting[~hit]
        return weight, after

    def traverse(self) -> np.ndarray:
        """The weight of every place's token, from left to right in lanes; 0 at the beginnings."""
        depth = self.listed.depth
        out = np.zeros(len(depth))
        starts = np.flatnonzero((depth > 0) & ((depth - 1) % LANE == 0))
        if not len(starts):
            return out
        ends = np.append(starts[1:], len(depth))
        ends -= np.append((depth[starts[1:]] == 1).astype(np.int64), 0)  # the next document's beginning
        sizes = ends - starts
        turn = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[turn], sizes[turn]
        state = self.begin(starts)
        for step in range(int(sizes[0])):
            lanes = int(np.searchsorted(-sizes, -step, side="left"))
            places = starts[:lanes] + step
            out[places], state = self.read(state[:lanes], places)
        return out


# --- scores -----------------------------------------------------------------------------------------------------------

_SCORE_SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score_rows(frames: Iterator[pd.DataFrame], order: int, bits: int, prior: tuple, tokens: int, words: int) -> Iterator[pd.DataFrame]:
    for rows in frames:
        for row in rows.itertuples(index=False):
            block = _block(row)
            listed = block.listed(order, bits)
            given = sorted(row.answers, key=lambda x: x["part"])
            counts = listed.by_order(np.concatenate([unpack(x["counts"], np.uint64) for x in given]).astype(np.int64))
            first = listed.at[0]
            begin = np.flatnonzero(listed.depth == 0)
            single = counts[0][first].astype(np.float64)
            base = np.log10((single + 1.0) / (tokens + words + 1.0))
            known = (single > 0).astype(np.int64)
            base[begin], known[begin] = 0.0, 0
            weights = Automaton(listed, counts, tokens, words, prior).traverse()
            ids, has = unpack(row.ids, np.int64), unpack(row.known, np.uint8).astype(bool)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([i if k else None for i, k in zip(ids.tolist(), has.tolist(), strict=True)], dtype="Int64"),
                    "train": block.train, "n_tokens": block.sizes, "n_known": np.add.reduceat(known, begin),
                    "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(weights, begin),
                }
            )


def scored(docs: DataFrame, train: Column, order: int = ORDER, prior: tuple[float, ...] = PRIOR) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``train``: a boolean column of ``docs``, true for the documents that the model is counted on.
    """
    if len(prior) < order - 1:
        raise ValueError("a prior is needed for every length of history")
    blocks = blocks_of(docs, train)
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train_tokens", "n_tokens")]).first()
    tokens = sums["n_train_tokens"]
    grams = max(1, sums["n_tokens"] * order)
    ranges, bits = max(2, -(-grams // RANGE)), min(62, SPARE + grams.bit_length())
    answers = answers_of(blocks, order, ranges, bits)
    # the beginning of a document is a gram of order one, but not a word; it is known if anything trains
    words = answers.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("v")).first()["v"] - (1 if tokens else 0)
    gathered = answers.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    joined = blocks.join(gathered, F.expr("block = of"))
    slim = joined.select("ids", "known", "train", "sizes", "words", "codes", "answers")
    out = slim.mapInPandas(lambda frames: _score_rows(frames, order, bits, prior, tokens, words), _SCORE_SCHEMA)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op12_automaton(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    out = scored(docs, remainder != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
