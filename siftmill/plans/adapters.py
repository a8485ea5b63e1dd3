"""The driver's tables as postings and pages, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.vocabulary import COUNTRY_LANGUAGE
from siftmill.tables import table

LANGUAGE_COUNTRY = {v: k for k, v in COUNTRY_LANGUAGE.items()}


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first six words are the title, the source is platform and employer."""
    d = table(spark, sf_dir, "documents")
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    country = F.create_map(*[F.lit(x) for kv in sorted(LANGUAGE_COUNTRY.items()) for x in kv])[F.col("lang")]
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.array_join(F.slice(F.split(text, "[ \n]"), 1, 6), " ").alias("title"),
        text.alias("description"),
        source.alias("platform"),
        F.concat(source, F.lit(" Ltd.")).alias("company"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/jobs/"), F.col("doc_id").cast("string")).alias("url"),
        "lang",
        country.alias("country"),
        (F.length(text) < 50).alias("thin"),
    )


_CASES = " ".join(f"WHEN '{lang}' THEN '{country}'" for lang, country in sorted(LANGUAGE_COUNTRY.items()))
POSTINGS = f"""postings AS (
  SELECT doc_id AS row_id, array_to_string(string_split_regex(coalesce(text, ''), '[ \\n]')[1:6], ' ') AS title,
         coalesce(text, '') AS description, coalesce(source, '') AS platform, coalesce(source, '') || ' Ltd.' AS company,
         'https://' || coalesce(source, '') || '.example.com/jobs/' || doc_id AS url, lang, CASE lang {_CASES} END AS country,
         length(coalesce(text, '')) < 50 AS thin
  FROM documents)"""


def sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
