"""The corpus pipeline: quality, exact copies, near copies, mixture and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import free_name, stored, table
from siftmill.llm.exact_dedup import exact_dedup
from siftmill.llm.mixing import mixed
from siftmill.llm.near_dedup import near_dedup
from siftmill.llm.packing import packed_texts
from siftmill.llm.quality import learn, scored

ACCEPT = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return scored(docs, model, into=score).filter(F.col(score) >= ACCEPT).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one that stays; rows are told apart by their places, not by their ids."""
    kept = stored(exact_dedup(docs).filter("kept").select("locator"), "kept")
    place = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    name = free_name(docs, "place")
    return docs.select("*", place.alias(name)).join(kept.withColumnRenamed("locator", name), name, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; documents without an id stay."""
    kept = near_dedup(docs).filter("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    return docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source has the same weight, in random order."""
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "source")  # so that no column takes the name of one of the mixture's
    return mixed(whole).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packed_texts(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
