"""Registered queries over vocabularies and languages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions import vocabulary as V
from siftmill.operators import languages as L
from siftmill.operators.vocabularies import learned_terms, own_terms, sections_hit, term_hits
from siftmill.plans.adapters import POSTINGS, postings, sql_squeezed
from siftmill.tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PER_LANGUAGE = 1_250


@query(
    rf"""WITH d AS (SELECT doc_id, lang, lower(text) AS t FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, lang, string_split(t, ' ') AS ws FROM d WHERE lang IS NOT NULL),
    p AS (SELECT lang, ws[k] AS a, ws[k + 1] AS b FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS k FROM w)),
    counts AS (SELECT lang, a || ' ' || b AS term, count(*) AS n FROM p WHERE regexp_full_match(a, '[\p{{L}}\p{{N}}_]+') AND regexp_full_match(b, '[\p{{L}}\p{{N}}_]+') GROUP BY ALL),
    terms AS (SELECT lang, term FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= {PER_LANGUAGE}),
    bits AS (SELECT doc_id, lang, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS ws, string_split_regex(t, '[\p{{L}}\p{{N}}_]+') AS gaps FROM d),
    pairs AS (SELECT doc_id, lang, ws[k] || ' ' || ws[k + 1] AS pair FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM bits) WHERE gaps[k + 1] = ' ')
    SELECT t.lang, t.term, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM pairs JOIN (SELECT lang, term, unnest(list_distinct([term, strip_accents(term)])) AS spelling FROM terms) t ON t.spelling = pair
    WHERE t.lang IN (pairs.lang, 'en') OR pairs.lang IS NULL OR pairs.lang NOT IN (SELECT lang FROM terms) GROUP BY ALL"""
)
def vocabulary_of_word_pairs(spark, sf_dir):
    """P5 and section 2.17: up to 5,000 terms, the most frequent word pairs of each language, and where they stand."""
    docs = table(spark, sf_dir, "documents")
    terms = stored(learned_terms(docs, PER_LANGUAGE), "vocabulary")
    hits = term_hits(docs.select(F.col("doc_id").alias("id"), "lang", F.lower("text").alias("text")), terms)
    return hits.groupBy("lang", "term").agg(F.countDistinct("id").alias("documents"), F.sum("n").alias("hits"))


_FULL = f"{sql_squeezed('title')} || ' ' || {sql_squeezed('description')}"
_SECTIONS = ", ".join(f"CASE WHEN {V.sql_hit_by_language(_FULL, 'lang', s)} THEN '{s}' END" for s in sorted(V.TERMS))


@query(f"WITH {POSTINGS} SELECT row_id, array_to_string(list_filter([{_SECTIONS}], lambda x: x IS NOT NULL), ',') AS sections FROM postings")
def vocabulary_sections(spark, sf_dir):
    """Every section that a posting hits, in its language and English, by one pass over its text."""
    p = postings(spark, sf_dir)
    text = F.concat(T.squeezed(F.col("title")), F.lit(" "), T.squeezed(F.col("description")))
    hit = sections_hit(p.select(F.col("row_id").alias("id"), "lang", text.alias("text")), own_terms(spark))
    return p.select(F.col("row_id").alias("id")).join(hit, "id", "left").select(F.col("id").alias("row_id"), F.coalesce(F.array_join("sections", ","), F.lit("")).alias("sections"))


@query(
    f"""WITH {L.sql_detected("SELECT lang, text FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND text IS NOT NULL", "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL")}
    SELECT doc_id, doc_id % 5 = 0 AS held_out, d.lang, coalesce(x.lang, 'unknown') AS found FROM documents d LEFT JOIN detected x ON x.id = doc_id"""
)
def language_by_ngrams(spark, sf_dir):
    """Section 2.11, detect_language: every whole text, by profiles of the texts outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    detect = L.detector(L.profiles(docs.filter("doc_id % 5 <> 0")))
    return docs.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "lang", detect("text").alias("found"))


@query(
    f"""WITH pieces AS (SELECT doc_id, lang, k, substr(text, k * 180 + 1, 180) AS text FROM (SELECT doc_id, lang, text, unnest(range(0, greatest(CAST(ceil(length(text) / 180) AS INTEGER), 1))) AS k FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0)),
    {L.sql_detected("SELECT lang, text FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND text IS NOT NULL", "SELECT doc_id * 1000000 + k AS id, text FROM pieces")}
    SELECT p.lang, coalesce(x.lang, 'unknown') AS found, count(*) AS pieces FROM pieces p LEFT JOIN detected x ON x.id = doc_id * 1000000 + k GROUP BY ALL"""
)
def language_of_pieces(spark, sf_dir):
    """Section 2.11 on short texts: all stretches of 180 characters of the held-out fold, by language and what was found."""
    docs = table(spark, sf_dir, "documents")
    detect = L.detector(L.profiles(docs.filter("doc_id % 5 <> 0")))
    pieces = docs.filter("doc_id % 5 = 0 AND text IS NOT NULL").select("lang", F.explode(L.windows(F.col("text"))).alias("piece"))
    return pieces.select("lang", detect("piece").alias("found")).groupBy("lang", "found").agg(F.count(F.lit(1)).alias("pieces"))
