"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / source size. The whole part is
taken as it is; the fractions are rounded together. Two fractional documents meet, words are moved at random from one to
the other, with odds that keep both expectations, until one of them is in or out; the other goes on to meet the next.
What a source takes in words stays the same at every meeting, so a source ends within one document of its target.

Meetings run in blocks of about ``BLOCK`` documents, chosen by hash: a source with a third of all rows is many blocks. A
block leaves at most one fractional document; these meet again in a tree of ``FAN`` blocks each, until one per source is
left, which is rounded to the nearer side. Only ids and sizes are shuffled. Draws come from the seed and the block's
place, so reruns agree.

Null, empty and blank texts have size 0: they take part with copies drawn by hash and take no words. A null source is a
source of its own, the last in order. Rows that repeat, or share a doc_id, are rounded as separate rows. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import documents, id_key, keyed_rows, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
BLOCK = 512
FAN = 64


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Words to take per source. ``sizes``: one row per source, with source, source_size.

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at ``ceiling`` times the source's
    size and the rest is shared out anew by weight, which ends at min(ceiling * size, level * weight) for one level:
    in order of size / weight, the first level that lies below the next source's stop.
    The table has one row per source, so its windows need no partition.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", F.get(turns, rank % len(weights)).alias("weight"))
    ranked = ranked.withColumn("stop", F.lit(float(ceiling)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.col("level"))
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = levels.withColumn("level", F.first(fits, True).over(whole))
    target = F.least(F.col("stop"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return final.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _meet(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of one block in the given order; returns the parts, at most one of them fractional."""
    out = part.copy()
    held = -1
    for i in range(len(size)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, s, t = out[held], out[i], size[held], size[i]
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
        if draws[i] * (up + down) < down:
            a, b = (1.0, b - up / t) if (1 - a) * s <= b * t else (a + up / s, 0.0)
        else:
            a, b = (0.0, b + down / t) if a * s <= (1 - b) * t else (a - down / s, 1.0)
        out[held], out[i] = a, b
        # what rounding errors leave next to an end is at that end
        done_a, done_b = not 1e-12 < a < 1 - 1e-12, not 1e-12 < b < 1 - 1e-12
        if done_a:
            out[held] = round(a)
        if done_b:
            out[i] = round(b)
        held = (-1 if done_b else i) if done_a else held
    return out


def _rounder(seed: int, level: int, last: bool):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents meet first: what is left at the end is then a small one
        rows = rows.sort_values(["size", "place", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["source_hash"].iloc[0]) & (2**63 - 1), int(rows["block"].iloc[0])])
        part = _meet(rows["size"].to_numpy(float), rows["part"].to_numpy(float), rng.random(len(rows)))
        rows["part"] = np.round(part) if last else part
        rows["block"] //= FAN
        return rows

    return block


def mixed_copies(docs: DataFrame, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and the whole number of copies to take of every row of ``docs``.

    ``docs``: doc_id, text, source. ``keep`` names further columns to hand through (small ones: they are shuffled).
    """
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *keep, word_count().alias("size")), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    totals = stored(totals, "mix-totals")
    targets = source_targets(totals.select("source", "source_size"))
    plan = totals.alias("t").join(targets.alias("g"), F.expr("t.source <=> g.source")).select(
        F.col("t.source").alias("to"), "t.source_size", "g.target", F.ceil(F.col("n") / BLOCK).alias("blocks")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = slim.join(plan, F.expr("source <=> to")).drop("to")
    rows = rows.select(
        "doc_id", "source", *keep, "size", "source_size", "target", "blocks",
        F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("part"),
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("place"),
        F.coalesce(F.xxhash64("source"), F.lit(0)).alias("source_hash"),
    )
    blank = F.when(F.pmod("place", F.lit(1 << 30)) / float(1 << 30) < F.col("part"), 1.0).otherwise(0.0)
    rows = rows.withColumn("part", F.when(F.col("size") == 0, blank).otherwise(F.col("part")))
    rows = rows.withColumn("block", F.pmod("place", "blocks").cast("long")).drop("blocks")
    most = totals.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 1
    level, decided, open_rows = 0, [], rows
    while True:
        last = most <= 1
        done = open_rows.groupBy("source", "block").applyInPandas(_rounder(seed, level, last), open_rows.schema)
        done = stored(done, f"mix-{level}")
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        decided.append(done.where(~fractional))
        if last:
            break
        open_rows, level, most = done.where(fractional), level + 1, -(-most // FAN)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", (F.col("whole") + F.col("part").cast("long")).alias("copies"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, as they are, each as often as the mix takes it."""
    hashed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    copies = mixed_copies(hashed, seed, keep=("text_hash",)).select(id_key().alias("to_id"), F.col("text_hash").alias("to_hash"), "copies")
    # rows alike in doc_id and text are told apart by their turn only
    copies = copies.groupBy("to_id", "to_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    joined = keyed_rows(docs).join(copies, F.expr("id = to_id AND text_hash = to_hash"))
    turn = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("id"))
    share = F.expr("CAST(copies DIV rows AS INT)") + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("int")
    return joined.withColumn("turn", turn).select("row", F.explode(F.array_repeat(F.lit(0), share)).alias("copy")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mixed_copies(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
