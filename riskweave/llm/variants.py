"""Spelling variant grouping: PartEnum signatures of letter multisets, joined by equality and verified.

A word's letters as a binary vector have a dimension for every letter and occurrence: "letter" has e1, e2, l1, r1, t1, t2. One letter
inserted or deleted changes one dimension, one replaced changes two, so near words have vectors of Hamming distance at most two. The dimensions are
dealt into ``PARTS`` parts; two of them at most hold a difference, and the signatures of a word are its vectors over all but two parts, for
every choice of the two. Near words share one at least (exactly so: nothing is lost to chance), which an equality join finds, and the edit
distance decides.

Words of few syllables share letters far more often than spellings, so a signature also has one half of the word as it stands: an edit in
one half leaves the other alone. Halves are those of the shorter word of a pair; a word enters once as the shorter one (its own half), and once as
the longer one for partners as long as itself and once for those one shorter. That keeps the join's groups small.

A variant's form is its most frequent near word, if that is ``TIMES`` as frequent; forms are followed to the last one by doubling the
steps. A form's count is ``TIMES`` its word's, so there are no circles, and the rounds grow with the logarithm of the longest chain.

A null or blank text has no runs. A null doc_id counts as empty text in the thinning of the query. Repeated rows, and rows that share an
id, count as often as they stand. Words of equal counts go by code points. An empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, stored
from riskweave.llm.text import mix

PARTS = 4
TIMES = 10
LEAST_LENGTH = 7
LEAST_COUNT = 2

#: a run of letters
RUN = "[A-Za-zÀ-ÿ]+"
#: fixed value: letters from frequent to rare, so that every part gets some of the frequent ones; it bears on speed only
_OFTEN = "enaitorhsuldcmgpbfvwzqxkjy"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(column: str = "text") -> Column:
    """A-Z as a-z; all other letters as they are."""
    return F.translate(column, _UPPER, _UPPER.lower())


def _dimensions(letters: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per letter of every word, the hash of its dimension (letter and occurrence) and its part."""
    order = np.lexsort((letters, word))
    letter, of = letters[order], word[order]
    new = np.ones(len(letter), dtype=bool)
    new[1:] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    nth = np.empty(len(letter), dtype=np.int64)
    nth[order] = np.arange(len(letter)) - np.repeat(first, np.diff(np.append(first, len(letter))))
    rank = letters.copy()
    for i, c in enumerate(_OFTEN):
        rank[letters == ord(c)] = i
    return mix((letters * (1 << 32) + nth).astype(np.uint64)), (rank + nth) % PARTS


def _halves(letters: np.ndarray, start: np.ndarray, size: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last ``half`` letters of every word."""
    front, back = np.zeros(len(size), dtype=np.uint64), np.ones(len(size), dtype=np.uint64)
    for j in range(int(half.max(initial=0))):
        use = np.flatnonzero(j < half)
        front[use] = mix(front[use] + letters[start[use] + j].astype(np.uint64) + np.uint64(2))
        back[use] = mix(back[use] + letters[start[use] + size[use] - 1 - j].astype(np.uint64) + np.uint64(2))
    return front, back


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """signature by word, as the shorter word of a pair; then by word, as the longer of a pair whose shorter word is one letter shorter."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size) - size
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    hashed, part = _dimensions(letters, np.repeat(np.arange(len(words)), size))
    vectors = []
    for p in range(PARTS):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(np.where(part == p, hashed, np.uint64(0)), dtype=np.uint64)])
        vectors.append(mix(total[start + size] - total[start] + np.uint64(p)))
    out = []
    for shorter in (size, size - 1):
        front, back = _halves(letters, start, size, np.maximum(shorter, 0) // 2)
        columns = []
        for gone in itertools.combinations(range(PARTS), 2):
            seen = mix(shorter.astype(np.uint64) * np.uint64(PARTS * PARTS) + np.uint64(gone[0] * PARTS + gone[1]))
            for p in range(PARTS):
                if p not in gone:
                    seen = mix(seen ^ vectors[p])
            columns += [mix(seen ^ front), mix(seen ^ mix(back))]
        out.append(np.stack(columns, axis=1))
    return out[0], out[1]


def _signature_rows(longer: bool):
    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            own, one_less = signatures(rows["word"].tolist())
            keys = np.concatenate([own, one_less], axis=1) if longer else own
            each = keys.shape[1]
            yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "word": rows["word"].repeat(each).array, "n": rows["n"].repeat(each).array})

    return rows_of


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of distinct words that differ by exactly one inserted, deleted or replaced letter, both ways round.

    ``words``: word (distinct, at least two letters), n.
    """
    schema = "key long, word string, n long"
    one = words.mapInPandas(_signature_rows(False), schema)
    other = words.mapInPandas(_signature_rows(True), schema).select(F.col("key").alias("k"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    longer = F.char_length("near") - F.char_length("word")
    close = (longer == 1) | ((longer == 0) & (F.col("word") < F.col("near")))
    found = one.join(other, (F.col("key") == F.col("k")) & close & (F.levenshtein("word", "near", 1) == 1))
    found = found.select("word", "n", "near", "near_n").distinct()
    return found.select(
        F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")
    ).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms ends, for every word that has one."""
    step = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        after = step.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = stored(step.join(after, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        step = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return step


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n).

    form: the near word with the largest n (ties: the first by code points), if that n is ``times`` the word's own or more.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, F.expr("word = of"), "left")
    formed = F.expr(f"-best.less >= {int(times)} * n")
    known = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    roots = _roots(known.where("form IS NOT NULL")).select(F.col("word").alias("of"), "root")
    return known.join(roots, F.expr("word = of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted(runs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words of a table of one row per occurrence that are long and frequent enough."""
    return runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def thinned_runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per run of letters, A-Z lowered; about one in 31 loses a letter, by the crc32 of its document and itself."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered(), F.lit(f"({RUN})"), F.lit(1))).alias("run"),
    ).where(F.char_length("run") >= least_length)
    h = F.crc32(F.concat_ws(":", "id", "run"))
    runs = runs.withColumn("h", h).withColumn("at", F.when(F.col("h") % 31 == 0, (F.col("h") % F.char_length("run")).cast("int")))
    less = F.concat(F.expr("substr(run, 1, at)"), F.expr("substr(run, at + 2)"))
    return runs.select(F.when(F.col("at").isNotNull(), less).otherwise(F.col("run")).alias("word"))


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return grouped(counted(thinned_runs(documents(spark, sf_dir))))
