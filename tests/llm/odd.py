"""Rows that operators must not trip over, with columns named like the operators' own."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old grey wall and sing".split()
STORY = " ".join(WORDS[i % 21] + str(i // 7) for i in range(120))
CLASHES = ["id", "text_hash", "row", "key", "size", "part", "block", "copies", "gone", "turn", "copy", "n_removed", "label"]

ROWS = [
    (None, None, None, None),
    (None, STORY + " without id", "en", "a"),
    (1, "", "en", "a"),
    (2, " \n\t ", "en", None),
    (3, STORY + "\nshort\n" + "x" * 5000, "en", "a"),
    (4, STORY, "fr", "b"),
    (5, STORY, "fr", "b"),
    (5, STORY, "fr", "b"),
    (6, STORY.replace("fox0", "fix0") + "\n" + STORY, None, "c"),
    (7, "longer " * 30_000, "de", ""),
    (8, "one", "de", "b"),
    (9, "Ünï çødé 🦊 " * 30, "de", "c"),
    (10, "mail a.b@c.example.org or +1 (377) 555-0271, 10.0.0.300 and 10.0.0.3, card 4111 1111 1111 1111", "en", "a"),
]


def odd_documents(spark):
    rows = [(*r, None if r[1] is None else len(r[1])) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def no_documents(spark):
    return odd_documents(spark).where("false")
