"""Contract columns of registered queries, on the query itself, against brute force over the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_text_operators import brute_windows, within_one_edit
from tokenizers import Tokenizer

from riskweave.llm import lines, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted((r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_op2_lines(spark, sf_dir, documents):
    """Equal lines at any length, lines within one edit where the longer has ten characters."""
    first, places = {}, []
    for doc_id, text, _ in documents:
        for no, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= lines.EQUAL:
                first.setdefault(line, (doc_id, no))
                places.append((doc_id, no, line))
    earliest = dict(first)
    halves = defaultdict(set)
    for line in first:
        for size in {len(line), len(line) - 1}:
            halves[size, 0, line[: size // 2]].add(line)
            halves[size, 1, line[len(line) - (size - size // 2) :]].add(line)
    for same in halves.values():
        for a in same if len(same) > 1 else ():
            for b in same:
                if a < b and max(len(a), len(b)) >= lines.NEAR and within_one_edit(a, b):
                    earliest[a] = min(earliest[a], first[b])
                    earliest[b] = min(earliest[b], first[a])
    gone = defaultdict(set)
    for doc_id, no, line in places:
        if earliest[line] < (doc_id, no):
            gone[doc_id].add(no)
    want = {d: (len(t.split("\n")), len(gone[d]), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t, _ in documents}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in run(spark, sf_dir, "op2_lines")}
    assert got == want and sum(map(len, gone.values())) > 20


def test_op3_mixing(spark, sf_dir, documents):
    rows = run(spark, sf_dir, "op3_mixing")
    size = {d: len(WORD.findall(t)) for d, t, _ in documents}
    of_source = defaultdict(int)
    for d, _, s in documents:
        of_source[s] += size[d]
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in rows} == {d: (size[d], of_source[s]) for d, _, s in documents}
    order = sorted(of_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(of_source.values()), {}, {s for s in order if of_source[s]}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * of_source[s]}
        for s in full or open_:
            target[s] = 2.0 * of_source[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken, source = defaultdict(int), {d: s for d, _, s in documents}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target.get(s, 0.0)) and 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    biggest = {s: max(size[d] for d, _, x in documents if x == s) for s in order}
    assert all(abs(taken[s] - target.get(s, 0)) <= biggest[s] + 1 for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, sf_dir, "op3_mixing")))


def test_op5_texts(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in run(spark, sf_dir, "op5_sketch")}
    prints = {}
    for i, (doc_id, text, _) in enumerate(documents):
        half, after = len(text) // 2, documents[(i + 1) % len(documents)][1]
        edited = text[: len(text) - half] + after[:half]
        assert rows[doc_id]["n_chars"] == len(text) and rows[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, rows[doc_id]["fingerprint"]) == rows[doc_id]["fingerprint"]


def test_op6_substrings(spark, sf_dir, documents):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, sf_dir, "op6_substrings"))
    assert got == brute_windows([(d, t) for d, t, _ in documents])


def test_op7_simhash(spark, sf_dir, documents):
    prints = {}
    for doc_id, text, _ in documents:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles], dtype=np.uint64)
        bits = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h) for b in range(64)]
        prints[doc_id] = sum(1 << b for b, on in enumerate(bits) if on)
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, sf_dir, "op7_simhash")}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_op9_packing(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t, _ in documents}
    pieces, windows = defaultdict(list), defaultdict(list)
    rows = run(spark, sf_dir, "op9_packing")
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in ((p, len(ids[d])) for d, p in pieces.items()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole
    assert pieces.keys() == ids.keys()
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) > 0.99 * 2048 * len(windows) - 2048


def test_encoder_that_remembers_little(monkeypatch, documents):
    """The same ids whatever a worker remembers, and no more remembered than it may."""
    from riskweave.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for _, t, _ in documents[:60]]
    whole = tokens.Encoder(path).encode(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    little = tokens.Encoder(path)
    for _ in range(2):
        ids, counts = zip(*(little.encode(texts[i : i + 7]) for i in range(0, 60, 7)), strict=True)
        assert np.array_equal(np.concatenate(ids), whole[0]) and np.array_equal(np.concatenate(counts), whole[1])
        assert len(little.code) <= 500
