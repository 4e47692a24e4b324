"""Small pieces that several operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.text import WORD
from riskweave.session import materialize

stored = materialize

#: sorts and joins a missing doc_id like any other value; ids themselves are taken to be larger
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(column: str = "doc_id") -> Column:
    """The id as a sort and join key that is never null: rows without an id come first and count as one document."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def word_count(column: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, so that none can clash with others), id and text_hash, which together name a row's document."""
    return docs.select(F.struct("*").alias("row"), id_key().alias("id"), F.xxhash64("text").alias("text_hash"))


def if_small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A written table marked for broadcast if it is counted to have at most so many rows, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def give_back() -> None:
    """Returns to the system what a task has freed: its worker lives on, and counts as the executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)
