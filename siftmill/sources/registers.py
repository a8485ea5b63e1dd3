"""Registers of employers from files, with a gate on their size and a choice of versions by age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_from_csv(spark: SparkSession, paths: list[str] | str, column: str, least: int, **options) -> DataFrame:
    """The distinct names of a CSV register. Fewer than ``least`` is an error: half a register is worse than an old one."""
    names = spark.read.csv(paths, header=True, **options).select(F.trim(column).alias("name")).filter("name <> ''").distinct()
    n = names.count()
    if n < least:
        raise ValueError(f"the register has {n} names, fewer than {least}")
    return names


def register_of_years(spark: SparkSession, files: dict[int, str], headings: list[str], least: int, **options) -> DataFrame:
    """The names of yearly CSV files with columns of their own: name, first_year, last_year and in how many of them.

    Of each file the column counts that is called one of ``headings``, blanks and case apart, the first of the list
    before the others. A file without one gives nothing; fewer names than ``least`` altogether are an error."""
    together = None
    for year, path in sorted(files.items()):
        rows = spark.read.csv(path, header=True, **options)
        said = {c.strip().lower(): c for c in reversed(rows.columns)}
        column = next((said[h.strip().lower()] for h in headings if h.strip().lower() in said), None)
        if column is not None:
            part = rows.select(F.trim(F.col(f"`{column.replace('`', '``')}`")).alias("name"), F.lit(year).alias("year"))
            together = part if together is None else together.unionByName(part)
    if together is None:
        raise ValueError(f"no file has a column called {' or '.join(headings)}")
    each = together.filter("name <> ''").groupBy("name", "year").agg(F.lit(1).alias("k"))
    names = each.groupBy("name").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("year").alias("years"))
    n = names.count()
    if n < least:
        raise ValueError(f"the register has {n} names, fewer than {least}")
    return names


def names_of_table(page: DataFrame, html: str = "html") -> DataFrame:
    """The first cell of each row of the tables of a page."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return page.select(F.explode(cells).alias("c")).select(F.trim(F.regexp_replace(F.regexp_replace("c", "<[^>]*>", " "), r"\s+", " ")).alias("name")).filter("name <> ''").distinct()


def current_version(register: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Of a table (country, name, fetched_at) each country's latest version, and whether it is older than ``days``."""
    last = register.groupBy("country").agg(F.max("fetched_at").alias("fetched_at"))
    stale = F.col("fetched_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return register.join(last, ["country", "fetched_at"]).withColumn("stale", stale)
