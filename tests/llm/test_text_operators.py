"""Operators on documents against brute force, on odd rows, empty tables and the small test tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from odd import CLASHES, ROWS, STORY, no_documents, odd_documents
from pyspark.sql import functions as F
from riskweave.llm import lines, mixing, packing, perplexity, pii, quality, simhash, sketch, substrings, tokens
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(1) for c in CLASHES})


def texts_of(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


# --- mixing


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 50), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 300 words by 5, 2, 1, 5: a stops at 20, the last at 80; b and c share 200 by 2 and 1, c stays below its stop
    assert got["a"] == 20 and got[None] == 80
    assert got["b"] == pytest.approx(400 / 3) and got["c"] == pytest.approx(200 / 3)


@pytest.mark.parametrize("make", [odd_documents, "docs"])
def test_mix_meets_targets(make, spark, docs):
    table = docs if make == "docs" else make(spark)
    rows = mixing.mixed_copies(table).collect()
    again = mixing.mixed_copies(table).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(rows) == table.count()
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest[source]


def test_mixed_rows_repeat(spark):
    table = odd_documents(spark)
    out = mixing.mixed(table)
    assert out.columns == table.columns
    copies = {(r["doc_id"], r["size"]): r["n"] for r in mixing.mixed_copies(table).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()}
    got = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for (doc_id, _), n in copies.items():
        want[doc_id] += n
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert mixing.mixed(no_documents(spark)).count() == 0


# --- near-duplicates


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    return {c: find(c) for c in distinct}


def test_fingerprints():
    texts = [t or "" for _, t, *_ in ROWS]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_links_are_complete_and_single(spark):
    rng = np.random.default_rng(1)
    codes = {0, 2**64 - 1}
    for centre in rng.integers(0, 2**63, 30).tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            codes.add(int(centre) ^ sum(1 << int(b) for b in flips))
    table = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "code long")
    got = [frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in simhash.linked(table).collect()]
    ordered = sorted(codes)
    want = {frozenset((a, b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("make", [odd_documents, "docs"])
def test_groups(make, spark, docs):
    table = docs if make == "docs" else make(spark)
    rows = simhash.near_groups(table).collect()
    assert len(rows) == table.count()
    root = brute_components({r["code"] % 2**64 for r in rows})
    smallest = {}
    for r in rows:
        k = root[r["code"] % 2**64]
        if r["doc_id"] is not None:
            smallest[k] = min(smallest.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == smallest.get(root[r["code"] % 2**64]) for r in rows)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert kept.count() == len(set(root.values()))


def test_groups_of_nothing(spark):
    assert simhash.one_of_each(no_documents(spark)).count() == 0


# --- lines


def within_one_edit(a, b):
    a, b = sorted((a, b), key=len, reverse=True)
    if len(a) - len(b) > 1:
        return False
    i = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def brute_lines(rows):
    first, seen = {}, []
    for doc_id, text in rows:
        for no, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= lines.SHORTEST:
                key = (doc_id if doc_id is not None else -(2**63), no)
                first[line] = min(first.get(line, key), key)
                seen.append((doc_id, text, no, key, line))
    near = dict(first)
    by_size = defaultdict(list)
    for line in first:
        by_size[len(line)].append(line)
    for line, at in first.items():
        for size in (len(line), len(line) + 1):
            for other in by_size[size]:
                if other != line and within_one_edit(line, other):
                    near[line] = min(near[line], first[other])
                    near[other] = min(near[other], at)
    gone = defaultdict(set)
    for doc_id, text, no, key, line in seen:
        if near[line] < key:
            gone[doc_id, text].add(no)
    return sorted("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, t]) for d, t in rows)


@pytest.mark.parametrize("make", [odd_documents, "docs"])
def test_lines(make, spark, docs):
    table = docs if make == "docs" else make(spark)
    got = lines.deduped(table)
    assert got.columns == table.columns
    assert sorted(r["text"] or "" for r in got.collect()) == brute_lines(texts_of(table))


def test_line_edits(spark):
    base = "a line that is long enough to count, really"
    edits = [base, base + "!", base.replace("long", "lung"), base.replace("long", "lon"), base.replace("long", "lengthy"), base[1:] + base[0]]
    table = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduped(table).collect()}
    assert [i for i in got if got[i] == ""] and {i for i in got if got[i] == ""} == {1, 2, 3}
    assert lines.deduped(no_documents(spark)).count() == 0


def test_short_lines(spark):
    rows = [
        (1, "Menu\n1.\n  \nof\nnineteen characters\ntenletters"),
        (2, "Menu \n2.\n\nor\nnineteen characters!\ntenlettors\n1."),
        (3, "tenletter\nMenus\n2.\n."),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduped(table, shortest=lines.EQUAL, near=lines.NEAR).collect()}
    assert got == {1: rows[0][1], 2: "2.\n\nor", 3: "Menus\n."}


# --- substrings


def brute_windows(rows):
    first = {}
    split = [(d if d is not None else -(2**63), WORD.findall(t)) for d, t in rows]
    for d, words in split:
        for k in range(len(words) - 19):
            first.setdefault(tuple(words[k : k + 20]), {}).setdefault(d, k)
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - 19):
            places = first[tuple(words[k : k + 20])]
            if min(places) < d or words[: k + 19] and any(words[j : j + 20] == words[k : k + 20] for j in range(max(0, k - 500), k)):
                gone.update(range(k, k + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(spark, docs):
    for table in (odd_documents(spark), docs):
        rows = substrings.removed_words(table).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
        plain = [(d, t) for d, t in texts_of(table) if not t.startswith("longer longer")]
        assert [g for g in got if g[1] != 30_000] == brute_windows(plain)
    # one window of equal words starts all others
    assert substrings.removed_words(odd_documents(spark)).where("doc_id = 7").first()["n_removed"] == 29_999
    assert substrings.removed_words(no_documents(spark)).count() == 0


def test_sliding_argmin():
    values = np.random.default_rng(3).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 5, 11):
        got = substrings.sliding_argmin(values, width)
        assert got.tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]


# --- sketches


def test_successors(spark, docs):
    for table in (odd_documents(spark), docs):
        rows = sketch.successive(table).collect()
        assert len(rows) == table.count()
        if table is docs:
            ordered = texts_of(table)
            by_id = {r["doc_id"]: r for r in rows}
            for k, (doc_id, text) in enumerate(ordered):
                after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                assert by_id[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert by_id[doc_id]["n_chars"] == len(text)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert sketch.successive(no_documents(spark)).count() == 0


def test_short_text_in_a_long_one(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    rows, want = [], []
    for i in range(30):
        part = words[i * 100 : i * 100 + 5 + i % 6]  # 1 to 6 shingles
        rows += [(2 * i, " ".join(part if i % 3 else part[:-1] + ["other"])), (2 * i + 1, " ".join(words))]
        want.append(1.0 if i % 3 else (i % 6) / (i % 6 + 1))
    got = {r["doc_id"]: r["near_next"] for r in sketch.successive(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i] for i in range(30)] == pytest.approx(want)
    unknown = sketch.likeness(np.array([1 << 47], dtype=np.uint64), np.arange(100, dtype=np.uint64))
    assert np.isnan(unknown)


def test_containment_and_merging():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 40_000)]
    small, large = " ".join(words[:2000]), " ".join(words)
    half = " ".join(words[:1000] + [f"v{i}" for i in range(1000)])
    a, b, c = sketch.sketches([small, large, half])
    assert sketch.likeness(a, b) == 1.0 and sketch.likeness(a, c) == pytest.approx(0.5, abs=0.12)
    first, second, whole = sketch.sketches([" ".join(words[:20_000]), " ".join(words[19_996:]), large])
    assert np.array_equal(sketch.merged(first, second), whole)
    assert np.array_equal(sketch.decoded(sketch.encoded(a)), a)


# --- personal data


def test_base_spans(spark):
    text = "x a.b@c.d-e.fr@z.com 1.2.3.4.5.6.7.8 999.1.1.1 +49 (30) 1234-5678 or 4111-1111 1111 1111 @no me@x"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    got = pii.base_spans(text)
    assert got["email"] == [m.span() for m in email.finditer(text)]
    assert got["ip"] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [text[a:b] for a, b in got["card"]] == ["4111-1111 1111 1111"]
    assert [text[a:b] for a, b in got["phone"]] == ["+49 (30) 1234-5678"]


def test_personal_spans(spark):
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_spans(odd_documents(spark)).collect()}
    assert len(rows) == len({r[0] for r in ROWS})
    assert [s["kind"] for s in rows[10]] == ["email", "phone", "ip", "card"]
    assert pii.personal_spans(no_documents(spark)).count() == 0


def test_further_spans_are_weighed(spark):
    """Spelled-out addresses like the many that the strict pattern knows are taken; numbers that all labelers doubt are not."""
    good = [(i, f"write to user{i}@mail{i % 7}.com or mail: user{i} (at) mail (dot) com today") for i in range(50)]
    bad = [(100 + i, f"order number x 123 4567 {8900 + i}") for i in range(50)]
    rows = pii.personal_spans(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert all(len(r["spans"]) == (2 if r["doc_id"] < 100 else 0) for r in rows)


def brute_base(text):
    """The four patterns of the contract, by regular expressions."""
    out = []
    for kind, pattern in zip(pii.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True):
        for m in re.finditer(pattern, text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            test = {"email": True, "ip": kind == "ip" and all(len(p) < 4 and int(p) < 256 for p in parts), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if test[kind]:
                out.append((m.start(), pii.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_base_columns_of_the_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, sf_dir).collect():
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(w for *_, w in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(j == i for _, j, _ in want) for i in range(4)]
        assert {w for *_, w in want} <= set(r["spans"].split(",")) | {""} if want else True


def test_base_spans_of_random_texts():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("0123..+- ()a@b255") for _ in range(rng.randrange(60)))
        got = sorted((s, i, f"{k}:{s}:{e}") for i, k in enumerate(pii.KINDS) for s, e in pii.base_spans(text)[k])
        assert got == brute_base(text), text


def test_long_runs_take_no_square_of_time():
    import time

    begin = time.time()
    for text in ("0" * 5000 + "1.1.1.1", "1" * 1_000_000, "a" * 1_000_000 + " dot ", "a at " * 200_000, "1." * 500_000, "+1(" * 300_000, "12 " * 300_000, "a@" * 400_000):
        base, failed = pii._strict(text)
        pii.further_spans(text, base, failed)
    assert time.time() - begin < 40
    assert pii.base_spans("0" * 5000 + "1.1.1.1")["ip"] == [(0, 5007)]


def test_near_misses_need_support(spark):
    """A card with a wrong check digit, and a national number, count where words say so."""
    rows = [(1, "my credit card is 4111 1111 1111 1112 thanks"), (2, "sequence 4111 1111 1111 1112 of numbers"), (3, "call my mobile 0301 555 1234 now"), (4, "invoice 0301 555 1234 of the order")]
    rows += [(10 + i, f"credit card 4111 1111 1111 1111 and phone +1 377 555 0{100 + i}") for i in range(40)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["card"] and got[2] == [] and got[3] == ["phone"] and got[4] == []


# --- perplexity


def brute_measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(k, k + 5))
    filled = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(filled) - len(set(filled)), len(covered))


def test_measures_and_bands(spark, docs):
    table = docs.unionByName(odd_documents(spark).drop(*CLASHES), allowMissingColumns=True)
    rows = perplexity.judged(table.select("doc_id", "text", "lang")).collect()
    want = Counter(brute_measures(t) for _, t in texts_of(table))
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    # text without symbols stays; what has them everywhere is judged in test_labelled_junk_is_rejected
    passed = [r for r in rows if not r["base_failed"] and 50 * r["n_symbols"] <= r["word_chars"]]
    assert len(passed) > 150 and sum(r["kept"] for r in passed) > 0.97 * len(passed)
    assert perplexity.judged(no_documents(spark)).count() == 0


def test_probabilities_sum_to_one(spark):
    table = spark.createDataFrame([(1, "abra cadabra abracad bra ab ra", "x")], "doc_id long, text string, lang string")
    model = perplexity.fit(table)
    code = np.uint64(perplexity.language_code("x"))
    context = np.uint64(ord("a") << 8 | ord("b"))  # after "ab"
    grams = np.array([code | (context << np.uint64(8)) | np.uint64(b) for b in range(256)], dtype=np.uint64)
    p = np.exp(model.log_probability(grams, np.full(256, 3)))
    assert p.sum() == pytest.approx(1.0, abs=1e-6) and p[ord("r")] > 10 * p[ord("z")]


def test_labelled_junk_is_rejected(spark):
    """Of labelled junk that passes the base rules nearly all is rejected, of good documents hardly any."""
    path = "/root/testdata/sf0.1"
    judged = perplexity.judged(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    rows = judged.where("NOT base_failed").select("quality", "kept").collect()
    junk, good = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(junk) > 200 and sum(junk) <= 0.05 * len(junk) and sum(good) >= 0.995 * len(good)


# --- packing


@pytest.mark.parametrize("make", [odd_documents, "docs"])
def test_packing_is_exact(make, spark, docs):
    table = docs if make == "docs" else make(spark)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.packed(table, TOKENIZER).collect()
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts_of(table) if d is not None}
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
            pieces[r["doc_id"]].append((r["start"], r["length"]))
    times = Counter(d for d, _ in texts_of(table))
    assert all(sum(n for _, n in p) == times[d] * len(ids[d]) for d, p in pieces.items()) and set(pieces) == set(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    padding = packing.WINDOW * len(windows) - sum(r["length"] for r in rows)
    assert padding < packing.WINDOW * table.rdd.getNumPartitions()


def test_odd_spaces_are_encoded_whole():
    from riskweave.llm.tokens import Encoder

    texts = ["a  b", " a", "a ", "a\n\nb", "a\n b", "a \nb", "a\tb", "a  b", "a.\nB, c", "", "don't, stop.", "x," * 3, "<|endoftext|> x", "é ü,ö"]
    encoder = Encoder(TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    for _ in range(2):
        flat, counts = encoder.encode(texts)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_differencing():
    sizes = np.random.default_rng(2).integers(1, 2000, 300).tolist()
    way = packing.difference(sizes, 40)
    sums = np.bincount(way, sizes, 40)
    assert len(way) == 300 and sums.max() - sums.min() < 0.2 * sums.mean()
    uncut = packing.pack([1500, 1500, 1500], cut=False)
    assert len(uncut) == 3 and all(len(w) == 1 for w in uncut)
    assert len(packing.pack([1500, 1500, 1000], cut=True)) == 2
    assert packing.pack([]) == []


# --- quality


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    known = labels.where("doc_id % 4 <> 0")
    judged = quality.judged(docs, known).join(labels.withColumnsRenamed({"quality": "good", "toxic": "bad"}), "doc_id")
    rows = judged.where("doc_id % 4 = 0").select("good", "bad", "rejected").collect()
    clean = [r["rejected"] for r in rows if r["good"] == 1 and r["bad"] == 0]
    other = [r["rejected"] for r in rows if r["good"] == 0 or r["bad"] == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(other) >= 0.95 * len(other)


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.2)] * 400 + [("small", "p", 0.2)] + [("other", "q", 0.9)] * 400
    table = spark.createDataFrame([(h, p, q) for h, p, q in rows], "host string, path string, quality double")
    got = {r["host"]: r["quality_site"] for r in quality.site_posteriors(table, "quality").collect()}
    assert got["big"] < 0.25 < got["small"] < 0.6 < got["other"]


def test_quality_of_odd_rows(spark):
    table = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 0, 1), (77, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judged(table, labels).count() == len(ROWS)
    assert quality.accepted(table, labels.where("false")).columns == table.columns
    assert quality.accepted(table, labels.where("false")).count() == len(ROWS)
    assert quality.accepted(no_documents(spark), labels).count() == 0


def test_story_is_long_enough():
    assert len(STORY.split()) == 120


def test_classifier_is_fitted_in_a_task(spark, monkeypatch):
    """The driver neither takes the sample nor fits: it gets the model of the one task that does."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    monkeypatch.setattr(quality, "train", None)  # the task's own module has it still
    model = quality.fit(docs, labels)
    assert model.words.any() and model.words.shape == (2, 1 << quality.BUCKETS)


def test_workers_free_tokens_before_other_work():
    """What packing has left in a worker is gone when the worker's next task judges or takes features of texts."""
    tokens.shared_encoder(TOKENIZER)
    assert list(quality._feature_rows(iter([]))) == [] and not tokens._ENCODERS


def test_fit_holds_few_numbers_per_entry():
    rng = np.random.default_rng(1)
    n, each = 2_000, 600
    bucket = np.sort(rng.integers(0, 1 << quality.BUCKETS, (n, each)).astype(np.int32), axis=1).ravel()
    doc, value = np.repeat(np.arange(n, dtype=np.int32), each), np.ones(n * each, dtype=np.float32)
    targets = np.stack([np.arange(n) % 2, np.arange(n) % 3 == 0], axis=1).astype(int)
    tracemalloc.start()
    model = quality.train(doc, bucket, value, rng.random((n, quality.SHAPES)), targets, rounds=2)
    peak = tracemalloc.get_traced_memory()[1] - 10 * (1 << quality.BUCKETS) * 8
    tracemalloc.stop()
    assert model.words.any() and peak < 29 * n * each


def test_sketch_has_one_worker_per_task(spark, docs, monkeypatch):
    """The variants of lines are made and sketched in one worker: no mapInPandas reads another's rows."""
    plans, made = [], type(docs).mapInPandas

    def noted(self, *args, **kwargs):
        out = made(self, *args, **kwargs)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(type(docs), "mapInPandas", noted)
    lines.partners(docs)
    for plan in plans:
        names = [x for x in re.findall(r"^\W*(?:\*\(\d+\) )?(\w+)", plan, re.MULTILINE) if x != "Project"]
        assert ("MapInPandas", "MapInPandas") not in zip(names, names[1:], strict=False), plan


def brute_perplexity(rows):
    """log perplexity of each text by interpolated modified Kneser-Ney over all n-grams, none folded."""
    def predicted(word):
        s = [perplexity._BEGIN, *word.encode(), perplexity._END]
        return [tuple(s[max(0, i - perplexity.ORDER + 1) : i + 1]) for i in range(1, len(s))]

    top = Counter((lang, g) for _, text, lang in rows for w in WORD.findall(text) for g in predicted(w))
    counts = {n: Counter({k: c for k, c in top.items() if len(k[1]) == n}) for n in range(1, perplexity.ORDER + 1)}
    for n in range(perplexity.ORDER - 1, 0, -1):
        counts[n].update((lang, g[1:]) for lang, g in counts[n + 1])
    less = {n: perplexity._discounts(Counter(c.values())) for n, c in counts.items()}
    total, back = Counter(), Counter()
    for n, c in counts.items():
        for (lang, g), k in c.items():
            total[n, lang, g[:-1]] += k
            back[n, lang, g[:-1]] += less[n][min(k, 3)]

    def p(lang, g):
        out = 1 / 256
        for n in range(1, len(g) + 1):
            of, k = (n, lang, g[-n:-1]), counts[n][lang, g[-n:]]
            if total[of]:
                out = max(k - less[n][min(k, 3)], 0) / total[of] + min(back[of] / total[of], 1) * out
        return math.log(out)

    logs = {d: [p(lang, g) for w in WORD.findall(text) for g in predicted(w)] for d, text, lang in rows}
    return {d: -sum(x) / max(len(x), 1) for d, x in logs.items()}


@pytest.mark.parametrize("most", [perplexity.MOST, 300, 0])
def test_no_gram_is_folded(spark, docs, most):
    """However many grams tasks may hold, down to none: the model is that of all n-grams as they are."""
    table = docs.where("text NOT RLIKE '[#*$%&|<>]' AND doc_id IS NOT NULL").orderBy("doc_id").limit(40).select("doc_id", "text", "lang")
    want = brute_perplexity([(r["doc_id"], r["text"], r["lang"] or "") for r in table.collect()])
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.judged(table, most=most).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_control_characters_are_bytes_of_their_own(spark):
    rows = [(1, "\x00ab \x02ab \x03ab ab\x00 ab\x02 ab\x03 ab abc", "x")] * 2
    got = perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=5).collect()
    assert len(got) == 2 and got[0] == got[1] and 0 < got[0]["log_perplexity"] < 6
