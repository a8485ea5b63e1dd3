"""Answers that come page by page: where reading stops, and which rows are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.operators.survivorship import first_wins


def read_until_nothing_new(answers: DataFrame, source: str, key: str, most_rows: int = 1000, most_pages: int = 20) -> DataFrame:
    """The rows that reading ``answers`` (page from 1, pos) from the first page on would collect.

    Of rows with one key the first counts. Reading of a source ends at its first page that is missing or brings nothing
    new, after ``most_pages`` pages, and at ``most_rows`` rows.
    """
    firsts = first_wins(answers.filter(F.col("page") <= most_pages), F.struct(source, key), [F.col("page"), F.col("pos")], keep_blank=False)
    pages = firsts.select(source, "page").distinct()
    # page k is read where it is the k-th that brings something
    read = pages.withColumn("_k", F.row_number().over(Window.partitionBy(source).orderBy("page"))).filter(F.col("_k") == F.col("page")).drop("_k")
    rows = firsts.join(read, [source, "page"])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy("page", "pos"))).filter(F.col("_n") <= most_rows).drop("_n")


def new_against_earlier_pages(answers: DataFrame, source: str, key: str) -> DataFrame:
    """Rows whose key no earlier page of their source has; repeats inside one page stay."""
    first = answers.groupBy(source, key).agg(F.min("page").alias("page"))
    return answers.join(first, [source, key, "page"], "left_semi")


def crawled(attempts: DataFrame, singles: DataFrame, tries: int = 4) -> DataFrame:
    """The outcome of each url of a crawl in batches: ``batch``, ``single`` or ``failed``.

    ``attempts`` has batch, attempt and ok, ``singles`` url, batch and ok, the url's outcome alone. A batch is tried
    ``tries`` times; one that never succeeds is split and its urls are taken one by one.
    """
    done = attempts.filter(F.col("attempt") <= tries).groupBy("batch").agg(F.bool_or("ok").alias("_done"))
    return singles.join(done, "batch", "left").select("url", "batch", F.when(F.coalesce("_done", F.lit(False)), "batch").when(F.col("ok"), "single").otherwise("failed").alias("outcome"))
