"""Quality rules with n-gram perplexity: a modified Kneser-Ney model that Spark counts over all documents.

The model predicts the bytes of a word from up to four bytes before it in the word, and the word's end, per language. Spark
counts the distinct words of every text, then the n-grams of the distinct words weighted by their counts; lower orders count in how many
contexts an n-gram appears, as Kneser and Ney have it, with three discounts per order. All of that are groupings that combine on the
map side. A gram is its bytes packed into 40 bits beside 24 bits of the language's hash, so suffix and context are shifts.

The model is counted on all documents but those with more than ``MOST_SYMBOLS`` percent of symbols: text with marks after every word, or a
bar between all of them, is to look strange to it, however much of the corpus it is.

The probability of every distinct gram of the documents is found by joins, order by order. The most frequent grams, at most ``MOST``, are
broadcast as sorted arrays (16 bytes each); a task looks each distinct word's grams up there. Where a corpus has more, a document's other grams
leave the task with how often it has them, and are joined with the table of all probabilities: no gram is folded or left out.
Two languages whose 24 bits agree would share a model.

A document's verdict: its log perplexity lies within a band around its language's median. The band is language-specific,
above and below, ``WIDTH`` times the spread of that side (median to quartile, as a standard deviation), and wider for short texts by
``SHORT`` / sqrt(bytes). Medians and quartiles are taken over all documents that pass the base rules.

A null text is empty: no words, base_failed. A null language is a language of its own. Repeated rows, shared or null ids are
rows of their own. A language none of whose documents pass the base rules has no band and keeps none. An empty table gives an empty
result; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, if_small, stored
from riskweave.llm.text import WORD, Words, batches, mix

ORDER = 5
MOST = 3_000_000
WIDTH = 6.0
SHORT = 6.0
MOST_SYMBOLS = 1.0
_BEGIN, _END = 2, 3
_GRAM = (1 << 40) - 1
#: bytes that stand for something else in a gram (nothing, begin, end) are others there, which UTF-8 never has
_SYMBOL = np.arange(256, dtype=np.uint64)
_SYMBOL[[0, _BEGIN, _END]] = 0xFD, 0xFE, 0xFF

#: fixed values: the characters that count as symbols
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS.encode())] = 1


def language_code(lang: str) -> int:
    """24 bits for a language, in the place above a gram."""
    code = 0
    for b in lang.encode("utf-8", "surrogatepass"):
        code = (code * 1000003 + b + 1) % (1 << 64)
    return int(mix(np.array([code], dtype=np.uint64))[0] >> np.uint64(40)) << 40


def packed_grams(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every predicted byte of the words ``buffer[start:end]``: its word, its gram of up to ORDER bytes, the gram's length."""
    sizes = end - start + 2
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    word = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(total) - np.repeat(ends - sizes, sizes)
    take = np.clip(np.repeat(start - 1, sizes) + depth, 0, max(len(buffer) - 1, 0))
    symbols = _SYMBOL[buffer[take]] if total else np.zeros(0, dtype=np.uint64)
    symbols[ends - sizes] = _BEGIN
    symbols[ends - 1] = _END
    gram = np.zeros(total, dtype=np.uint64)
    for back in range(ORDER):
        shifted = np.zeros(total, dtype=np.uint64)
        shifted[back:] = symbols[: total - back] if back else symbols
        gram |= np.where(depth >= back, shifted, np.uint64(0)) << np.uint64(8 * back)
    predicted = depth > 0
    return word[predicted], gram[predicted], np.minimum(depth[predicted] + 1, ORDER)


def _gram_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        for low, high in batches(rows["word"].tolist(), 500_000):
            part = rows.iloc[low:high]
            parts = [w.encode("utf-8", "surrogatepass") for w in part["word"]]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ends = np.cumsum(sizes)
            word, gram, _ = packed_grams(np.frombuffer(b"".join(parts), dtype=np.uint8), ends - sizes, ends)
            codes = {lang: language_code(lang) for lang in part["lang"].unique()}
            language = part["lang"].map(codes).to_numpy(dtype=np.uint64)
            keys, inverse = np.unique(gram | language[word], return_inverse=True)
            sums = {c: np.bincount(inverse, part[c].to_numpy(float)[word], len(keys)).astype(np.int64) for c in ("n", "times")}
            yield pd.DataFrame({"gram": keys.view(np.int64)} | sums)


def language(column: str = "lang"):
    return F.coalesce(F.col(column), F.lit("\x00"))


def gram_table(docs: DataFrame) -> DataFrame:
    """gram, size, how often the documents that the model is counted on have it (n), and how often all have it (times)."""
    counts = F.coalesce(_is_plain().cast("long"), F.lit(0).cast("long")).alias("counts")
    slim = docs.select(language().alias("lang"), counts, "text")  # beside the explode it would be asked again for every word
    words = slim.select("lang", "counts", F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.sum("counts").alias("n"), F.count("*").alias("times"))
    grams = counted.mapInPandas(_gram_rows, "gram long, n long, times long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    own = F.col("gram").bitwiseAND(F.lit(_GRAM))
    size = F.lit(1)
    for n in range(1, ORDER):
        size = size + (own >= F.lit(1 << (8 * n))).cast("int")
    return stored(grams.withColumn("size", size), "kn-grams")


def _suffix(n: int) -> Column:
    """A gram's last ``n`` bytes, with its language."""
    return F.col("gram").bitwiseAND(F.lit(~_GRAM | ((1 << (8 * n)) - 1)))


def _context() -> Column:
    """A gram without its last byte, with its language."""
    return F.col("gram").bitwiseAND(F.lit(~_GRAM)).bitwiseOR(F.shiftright(F.col("gram").bitwiseAND(F.lit(_GRAM)), 8))


def adjusted_counts(grams: DataFrame) -> DataFrame:
    """order, gram, n: counts of whole grams, and for lower orders the number of bytes that they are seen after."""
    sized = grams.where("n > 0").select(F.col("size").alias("order"), "gram", "n")
    level = sized.where(F.col("order") == ORDER)
    out = level
    for n in range(ORDER - 1, 0, -1):
        seen = level.groupBy(_suffix(n).alias("gram")).agg(F.count("*").alias("n")).select(F.lit(n).alias("order"), "gram", "n")
        level = seen.unionByName(sized.where(F.col("order") == n))
        out = out.unionByName(level)
    return out


def _discounts(kinds: dict[int, int]) -> list[float]:
    """What is taken off counts of 0, 1, 2, and 3 or more, from the numbers of grams counted 1 to 4 times."""
    k1, k2, k3, k4 = (float(kinds.get(i, 0)) for i in (1, 2, 3, 4))
    y = k1 / (k1 + 2 * k2) if k1 else 0.5
    steps = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, k1, k2), (2, k2, k3), (3, k3, k4))]
    return [0.0, *(float(np.clip(d, 0.05, i)) for i, d in enumerate(steps, 1))]


class Model:
    """The adjusted counts, a table of order, gram, n, and the discounts of each order."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        kinds = counts.where("n <= 4").groupBy("order", "n").agg(F.count("*").alias("kinds")).collect()
        self.discounts = {o: _discounts({r["n"]: r["kinds"] for r in kinds if r["order"] == o}) for o in range(1, ORDER + 1)}

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """gram, times, and the log probability of each gram's last byte after those before it. ``grams``: distinct gram, with size, times."""
        asked = {ORDER: grams.where(F.col("size") == ORDER).select("gram", "times")}
        for n in range(ORDER - 1, 0, -1):
            shorter = asked[n + 1].select(_suffix(n).alias("gram"), F.lit(None).cast("long").alias("times"))
            whole = grams.where(F.col("size") == n).select("gram", "times")
            asked[n] = stored(whole.unionByName(shorter).groupBy("gram").agg(F.max("times").alias("times")), f"kn-asked-{n}")
        out, lower = None, None
        for n in range(1, ORDER + 1):
            d = self.discounts[n]
            counts = self.counts.where(F.col("order") == n)
            count = F.col("n")
            less = F.when(count >= 3, d[3]).when(count == 2, d[2]).when(count == 1, d[1])
            of_context = counts.groupBy(_context().alias("of")).agg(F.sum("n").alias("total"), F.sum(less).alias("less"))
            rows = asked[n].join(counts.select(F.col("gram").alias("counted"), "n"), F.col("gram") == F.col("counted"), "left")
            rows = rows.join(of_context.withColumnRenamed("less", "back"), _context() == F.col("of"), "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1 / 256))
            else:
                rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), _suffix(n - 1) == F.col("suffix"), "left")
            share = F.coalesce(F.greatest(count - less, F.lit(0.0)), F.lit(0.0)) / F.col("total")
            p = F.when(F.col("total").isNull(), F.col("below")).otherwise(share + F.least(F.col("back") / F.col("total"), F.lit(1.0)) * F.col("below"))
            lower = stored(rows.select("gram", "times", p.alias("p")), f"kn-order-{n}")
            out = lower if out is None else out.unionByName(lower)
        return out.where("times IS NOT NULL").select("gram", "times", F.log(F.greatest("p", F.lit(1e-12))).alias("log"))

    def log_probability(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same of a few grams of the caller's."""
        asked = pd.DataFrame({"gram": grams.view(np.int64), "size": sizes, "times": 1})
        found = self.probabilities(self.counts.sparkSession.createDataFrame(asked.drop_duplicates("gram"))).toPandas()
        return found.set_index("gram")["log"].reindex(asked["gram"]).to_numpy()


class Head:
    """The most frequent grams in order, and their log probabilities."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.logs = grams[order], logs[order]

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 for grams that are not held, and which are held. Most grams stand in many words: each is looked up once."""
        gram, inverse = np.unique(grams, return_inverse=True)
        if not len(self.grams):
            return np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        held = self.grams[at] == gram
        return np.where(held, self.logs[at], 0.0)[inverse], held[inverse]


def _is_plain(percent: float = MOST_SYMBOLS) -> Column:
    """Whether a text has at most so many symbols in a hundred characters."""
    bare = F.char_length(F.translate("text", SYMBOLS, ""))
    return F.char_length("text") - bare <= F.char_length("text") * (percent / 100)


def _model(grams: DataFrame) -> Model:
    return Model(stored(adjusted_counts(grams), "kn-counts"))


def fit(docs: DataFrame) -> Model:
    return _model(gram_table(docs))


def head_and_rest(table: DataFrame, most: int = MOST) -> tuple[Head, DataFrame | None]:
    """At most ``most`` of the most frequent grams, for the tasks to hold, and the rows of all others, if there are any."""
    by_times = table.groupBy(F.floor(F.log2("times")).cast("int").alias("power")).agg(F.count("*").alias("grams")).collect()
    held, power = 0, 64
    for row in sorted(by_times, key=lambda r: -r["power"]):
        if held + row["grams"] > most:
            break
        held, power = held + row["grams"], row["power"]
    power = 0 if held == sum(r["grams"] for r in by_times) else power
    in_head = F.floor(F.log2("times")).cast("int") >= power
    got = table.where(in_head).select("gram", "log").toArrow()
    head = Head(*(got.column(c).to_numpy() for c in ("gram", "log")))
    return head, table.where(~in_head) if power else None


def _repeated(words: Words, length: int = 5) -> np.ndarray:
    """Per text: its words that lie in windows of ``length`` words found twice or more in it."""
    starts, hashes = words.windows(length)
    doc = words.doc[starts]
    key = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = starts[order[twice]]
    cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + length, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    filled = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(filled) - len(set(filled))


def _not_held(words: Words, inverse: np.ndarray, word: np.ndarray, gram: np.ndarray, n: int) -> tuple[list, list]:
    """Per text, the given grams of its distinct words (``word`` of ``inverse``) and how often it has them; None where it has none."""
    grams, often = [None] * n, [None] * n
    order = np.argsort(word, kind="stable")
    word, gram = word[order], gram[order]
    size = np.bincount(word, minlength=int(inverse.max()) + 1 if len(inverse) else 0)
    first = np.cumsum(size) - size
    use = np.flatnonzero(size[inverse] > 0)
    if not len(use):
        return grams, often
    pair, times = np.unique(words.doc[use] * len(size) + inverse[use], return_counts=True)
    doc, of = pair // len(size), pair % len(size)
    sizes = size[of]
    ends = np.cumsum(sizes)
    take = gram[np.repeat(first[of] - (ends - sizes), sizes) + np.arange(ends[-1])].view(np.int64)
    times = np.repeat(times, sizes)
    texts, begin = np.unique(np.repeat(doc, sizes), return_index=True)
    for t, a, b in zip(texts.tolist(), begin.tolist(), [*begin[1:].tolist(), len(take)], strict=True):
        grams[t], often[t] = take[a:b], times[a:b]
    return grams, often


def measures(texts: list[str], langs: list[str], head: Head) -> pd.DataFrame:
    """The base measures of each text, the summed logs of its grams that are held, and those that are not."""
    words = Words(texts)
    raw = np.frombuffer(words.buffer, dtype=np.uint8)
    n = words.counts()
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw])])[words.bounds]
    chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])[words.first]
    codes = {lang: language_code(lang) for lang in set(langs)}
    language = np.array([codes[x] for x in langs], dtype=np.uint64)
    _, one, inverse = np.unique(words.hash ^ mix(language)[words.doc], return_index=True, return_inverse=True)
    word, gram, _ = packed_grams(raw, words.start[one], words.end[one])
    gram = gram | language[words.doc[one]][word]
    log, held = head.look_up(gram.view(np.int64))
    logs = np.bincount(word, log, len(one)) if len(one) else np.zeros(0)
    summed = np.concatenate([[0.0], np.cumsum(logs[inverse])])[words.first] if len(one) else np.zeros(len(texts) + 1)
    symbols_predicted = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])[words.first]
    rest, often = _not_held(words, inverse, word[~held], gram[~held], len(texts))
    return pd.DataFrame(
        {
            "n_words": n,
            "word_chars": np.diff(chars),
            "n_symbols": np.diff(symbols),
            "n_dup_lines": [_repeated_lines(t) for t in texts],
            "n_repeat_words": _repeated(words),
            "logs": np.diff(summed),
            "predicted": np.diff(symbols_predicted),
            "rest": rest,
            "often": often,
        }
    )


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCORED = "logs double, predicted long, rest array<long>, often array<long>"


def measured(docs: DataFrame, held: Broadcast) -> DataFrame:
    """row (a number of its own), doc_id, lang and the measures of every row, with a broadcast ``Head``."""

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        for rows in frames:
            texts, langs = rows["text"].tolist(), rows["lang"].tolist()
            for low, high in batches(texts, 3_000_000):
                part = measures(texts[low:high], langs[low:high], held.value)
                part.insert(0, "row", np.arange(number, number + high - low))
                part.insert(1, "doc_id", rows["doc_id"].iloc[low:high].astype("Int64").array)
                part.insert(2, "lang", langs[low:high])
                number += high - low
                yield part

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(rows_of, f"row long, doc_id long, lang string, {MEASURES}, {SCORED}")


def scored(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, lang, the base measures, predicted and log_perplexity of every row; tasks hold ``most`` grams at most."""
    grams = gram_table(docs)
    head, others = head_and_rest(_model(grams).probabilities(grams), most)
    held = docs.sparkSession.sparkContext.broadcast(head)
    rows = stored(measured(docs, held), "kn-measures")
    held.destroy()
    logs = F.col("logs")
    if others is not None:
        asked = rows.where("rest IS NOT NULL").select("row", F.explode(F.arrays_zip("rest", "often")).alias("x"))
        found = asked.join(others.select("gram", "log"), F.col("x.rest") == F.col("gram"))
        found = found.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("x.often") * F.col("log")).alias("more"))
        rows = rows.join(found, F.col("row") == F.col("of"), "left")
        logs = logs + F.coalesce("more", F.lit(0.0))
    rows = rows.withColumn("log_perplexity", -logs / F.greatest("predicted", F.lit(1)))
    rows = rows.select("doc_id", "lang", *[m.split()[0] for m in MEASURES.split(", ")], "predicted", "log_perplexity")
    return rows if others is None else stored(rows, "kn-scored")


def judged(docs: DataFrame, width: float = WIDTH, short: float = SHORT, most: int = MOST) -> DataFrame:
    """Measures, base_failed and kept for every row of ``docs`` (doc_id, text, lang)."""
    rows = scored(docs, most)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10000)
    bands = if_small(stored(rows.where("NOT base_failed").groupBy(F.col("lang").alias("of")).agg(quartiles.alias("q")), "kn-bands"))
    slack = F.lit(short) / F.sqrt(F.greatest("predicted", F.lit(1)))
    low = F.col("q")[1] - width * (F.col("q")[1] - F.col("q")[0]) / 0.6745 - slack
    high = F.col("q")[1] + width * (F.col("q")[2] - F.col("q")[1]) / 0.6745 + slack
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(low, high)
    return rows.join(bands, F.col("lang") == F.col("of"), "left").select(rows["*"], F.coalesce(kept, F.lit(False)).alias("kept"))


def op8_perplexity(spark, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.exp("log_perplexity").alias("perplexity"),
    )
