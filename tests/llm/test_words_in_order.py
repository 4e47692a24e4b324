"""Spelling variants, automaton scores and periodic runs against brute force: whole queries, odd rows and crafted texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from odd import CLASHES, no_documents, odd_documents
from pyspark.sql import functions as F

from riskweave.llm import automaton, periodic, queries, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df, tmp_path):
    """A folder with a documents table, as queries read it."""
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def texts_of(spark, path):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


# --- 11 ---------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_of(counts):
    """All near words, by deletion variants and the full edit distance."""
    by = defaultdict(set)
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[v].add(w)
    near = defaultdict(set)
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            near[w] |= {x for x in by[v] if x != w and edits(w, x) == 1}
    return near


def variant_rows(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = near_of(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


COLUMNS_11 = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_query(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.QUERIES["op11_variants"](spark, sf_dir).select(COLUMNS_11).collect())
    assert got == variant_rows(texts_of(spark, sf_dir))


def test_variants_of_crafted_words(spark, tmp_path):
    """Chains of forms, ties, near words at either end, in the middle, of one letter only, beyond ASCII, and anagrams that are not near."""
    rng = random.Random(3)
    base = ["spelling", "spellings", "spellin", "sspelling", "spalling", "gnilleps", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "éléphant", "eléphant", "élephant", "ÿÿÿÿÿÿÿ", "×÷×÷×÷×"]
    base += ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(300)]
    often = {w: rng.choice([2, 3, 5, 20, 33, 200, 400, 3000]) for w in base}
    text = " ".join(w.upper() if i % 3 == 0 else w for w, n in often.items() for i in range(n))
    docs = spark.createDataFrame([(i, text) for i in range(2)] + [(None, "spellingg spellingg"), (5, None), (5, "")], "doc_id long, text string")
    path = written(docs, tmp_path)
    got = sorted(tuple(r) for r in variants.op11_variants(spark, path).select(COLUMNS_11).collect())
    want = variant_rows(texts_of(spark, path))
    assert got == want and any(r[1] is not None and r[2] != r[1] for r in want)


def test_every_near_pair_shares_a_signature():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 14)))
        for i in range(len(word)):
            for near in (word[:i] + "x" + word[i:], word[:i] + "x" + word[i + 1 :], word[:i] + word[i] + word[i:]):
                short, long = sorted((word, near), key=len)
                own, other = variants.signatures([short, long])
                assert {*own[0].tolist()} & ({*own[1].tolist()} | {*other[1].tolist()})


# --- 12 ---------------------------------------------------------------------------------------------------------------


def automaton_rows(docs, prior=automaton.PRIOR):
    """The scores by the formula of the model, from plain counts."""
    seqs = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [w.translate(LOWER) for w in WORD.findall(t)] + ["\n"]) for i, t in docs]
    counts = Counter()
    for _, held, seq in seqs:
        if not held:
            line = ["\r", *seq]
            for end in range(1, len(line) + 1):
                for n in (1, 2, 3):
                    if end >= n:
                        counts[tuple(line[end - n : end])] += 1
    single = {g: c for g, c in counts.items() if len(g) == 1 and g != ("\r",)}
    total, kinds = sum(single.values()), len(single)

    def p(word, history):
        if not history:
            return (counts[(word,)] + 1) / (total + kinds + 1)
        m = prior[len(history) - 1]
        return (counts[(*history, word)] + m * p(word, history[1:])) / (counts[history] + m)

    out = []
    for i, held, seq in seqs:
        line = ["\r", *seq]
        score = sum(math.log10(p(line[k], tuple(line[max(0, k - 2) : k]))) for k in range(1, len(line)))
        base = sum(math.log10((counts[(w,)] + 1) / (total + kinds + 1)) for w in seq)
        out.append((i, held, len(seq), sum(counts[(w,)] > 0 for w in seq), total, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


COLUMNS_12 = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_automaton_query(spark, sf_dir):
    rows = queries.QUERIES["op12_automaton"](spark, sf_dir).select(COLUMNS_12).collect()
    same_scores(rows, automaton_rows(texts_of(spark, sf_dir)))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("lane, block, range_", [(3, 40, 50), (512, 3_000_000, 2_000_000)])
def test_automaton_in_small_pieces(spark, tmp_path, monkeypatch, lane, block, range_):
    """Lanes, blocks and ranges far smaller than texts change nothing."""
    for name, value in (("LANE", lane), ("BLOCK", block), ("RANGE", range_)):
        monkeypatch.setattr(automaton, name, value)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("a b A c dd ee") for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(7, "new words only"), (None, "a b"), (3, None)]
    path = written(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path)
    same_scores(automaton.op12_automaton(spark, path).select(COLUMNS_12).collect(), automaton_rows(texts_of(spark, path)))


def test_probabilities_sum_to_one():
    """After every history of a small automaton that text can follow, over all its words and one unknown."""
    import numpy as np

    rng = np.random.default_rng(2)
    words = np.arange(100, 108, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[7] = 2  # the end
    codes = rng.integers(0, 7, 180).astype(np.uint32)
    codes[29::30] = 7
    listed = automaton.Block(words, codes, np.full(6, 30), np.ones(6, dtype=bool)).listed(3)
    model = automaton.Automaton(listed, listed.by_order(listed.counts().astype(np.int64)), 180, 8)
    first = listed.at[0]
    begin, end = first[0], first[-1]
    arcs = defaultdict(dict)  # state -> token -> weight
    for n in range(3):
        for gram, place in enumerate(listed.shown[n]):
            if first[place] != begin and model.has[n][gram]:
                state = model.state_of[n - 1][listed.at[n - 1][place - 1]] if n else 0
                arcs[int(state)][int(first[place])] = model.weight[n][gram]
    ended = {int(model.state_of[n][gram]) for n in (0, 1) for gram, place in enumerate(listed.shown[n]) if first[place] == end}
    for start in sorted({*range(len(model.fails))} - ended):
        total = 0.0
        for token in {*range(len(model.has[0]) + 1)} - {int(begin)}:
            back, state = 0.0, start
            while state and token not in arcs[state]:
                back, state = back + model.fail_weight[state], int(model.fails[state])
            total += 10 ** (back + arcs[state].get(token, model.unknown))
        assert total == pytest.approx(1.0)


# --- 13 ---------------------------------------------------------------------------------------------------------------


def runs_by_hand(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(6, 4 * q) and not any(w[a : b - p] == w[a + p : b] for p in range(1, q)):
                out.append((a, b - a, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_rows(docs):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(text)
        n = len(w)
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(runs), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS_13 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query(spark, sf_dir):
    got = queries.QUERIES["op13_periodic"](spark, sf_dir).select(COLUMNS_13).collect()
    docs = [(i, t) for i, t in texts_of(spark, sf_dir) if len(t) < 30_000]  # the brute force is cubic
    ids = {i for i, _ in docs}
    assert len(docs) > 150 and sorted((tuple(r) for r in got if r["doc_id"] in ids), key=repr) == periodic_rows(docs)


def crafted_texts():
    rng = random.Random(1)
    texts = []
    for _ in range(400):
        n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 5])
        words = []
        if rng.random() < 0.4:
            words = [rng.randrange(k) for _ in range(n)]
        while len(words) < n:
            piece = [rng.randrange(k + 1) for _ in range(rng.randrange(1, 12))]
            words += (piece * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        texts.append(" ".join(map(str, words[:n])))
    fibonacci, thue = ("0", "0 1"), "0"
    for _ in range(10):
        fibonacci = fibonacci[1], f"{fibonacci[1]} {fibonacci[0]}"
        thue = f"{thue} {thue.translate(str.maketrans('01', '10'))}" if len(thue) < 400 else thue
    return [*texts, fibonacci[1], " ".join([thue] * 5), "x " * 200]


def test_periodic_crafted(spark, tmp_path):
    docs = list(enumerate(crafted_texts())) + [(None, "a b " * 20), (3, "a b " * 20), (3, "a b " * 20), (4, None)]
    path = written(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path)
    got = periodic.op13_periodic(spark, path).select(COLUMNS_13).collect()
    assert sorted((tuple(r) for r in got), key=repr) == periodic_rows(texts_of(spark, path))


def test_periodic_long_texts_take_no_square_of_time():
    thue = " ".join("ab"[bin(i).count("1") % 2] for i in range(1 << 16))
    for text, want in (("longer " * 200_000, [(0, 200_000, 1)]), (thue, []), ("a b c d " * 50_000, [(0, 200_000, 4)])):
        out = periodic._batch([1], [text], 4, 6, None)
        assert [(r["start"], r["length"], r["period"]) for r in out["runs"][0]] == want


# --- all three --------------------------------------------------------------------------------------------------------

BY_HAND = {
    "op11_variants": (COLUMNS_11, variant_rows),
    "op12_automaton": (COLUMNS_12, automaton_rows),
    "op13_periodic": (COLUMNS_13, periodic_rows),
}


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_odd_and_empty_tables(spark, tmp_path, name):
    """Nulls, blank and long texts, repeated rows and columns with clashing names; then no rows at all."""
    columns, by_hand = BY_HAND[name]
    docs = odd_documents(spark).where("doc_id IS NULL OR doc_id <> 7").withColumns({c: F.lit("x") for c in [*CLASHES, "word", "n", "block", "train", "runs"]})
    path = written(docs, tmp_path / "odd")
    got, want = queries.QUERIES[name](spark, path).select(columns).collect(), by_hand(texts_of(spark, path))
    if name == "op12_automaton":
        same_scores(got, want)
    else:
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert queries.QUERIES[name](spark, written(no_documents(spark), tmp_path / "none")).count() == 0


def test_one_word_thirty_thousand_times(spark, tmp_path):
    path = written(odd_documents(spark).where("doc_id = 7"), tmp_path)
    assert variants.op11_variants(spark, path).count() == 0  # "longer" has six letters
    row = periodic.op13_periodic(spark, path).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 30_000, 1)
    same_scores(automaton.op12_automaton(spark, path).select(COLUMNS_12).collect(), automaton_rows(texts_of(spark, path)))
