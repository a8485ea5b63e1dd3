"""Best-copy survivorship, the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.survivorship import first_wins
from siftmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def dedup_best_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct posting text: the longest original, then the smallest id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "source", F.length("text").alias("n_chars"), F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return first_wins(docs, F.col("key"), [-F.col("n_chars"), F.col("doc_id")], keep_blank=False).select("doc_id", "source", "n_chars", "key")


QUERIES["dedup_best_copy"] = dedup_best_copy
ORACLES["dedup_best_copy"] = """
SELECT doc_id, source, n_chars, key FROM (
  SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars, sha256(lower(trim(text, ' '))) AS key,
         row_number() OVER (PARTITION BY sha256(lower(trim(text, ' '))) ORDER BY length(text) DESC, doc_id) AS rn
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents))
WHERE rn = 1
"""
