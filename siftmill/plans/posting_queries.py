"""Registered queries over postings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions import vocabulary as V
from siftmill.functions.dates import age_days, not_stale, posted_at, within_window
from siftmill.operators import predicates as P
from siftmill.operators.ordering import placed
from siftmill.operators.survivorship import dedup_text_greedy, pool_fingerprint, twin_edges, greedy
from siftmill.plans.adapters import POSTINGS, postings, sql_squeezed
from siftmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_postings: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {POSTINGS} {sql}" if with_postings else sql
        return f

    return add


FULL = f"{sql_squeezed('title')} || ' ' || {sql_squeezed('description')}"
SELLS = V.sql_hit


def full_text(p: DataFrame):
    return F.concat(T.squeezed(F.col("title")), F.lit(" "), T.squeezed(F.col("description")))


@query(
    f"""SELECT row_id,
      CASE WHEN NOT r AND o THEN false WHEN d OR days THEN false WHEN thin THEN true WHEN NOT r THEN false ELSE NOT hedged END AS keep_remote,
      CASE WHEN d OR o OR thin THEN true ELSE NOT r END AS keep_not_remote
    FROM (SELECT row_id, thin, {SELLS(FULL, 'remote')} AS r, {SELLS(FULL, 'on_site')} AS o, {SELLS(FULL, 'not_remote')} AS d,
      {P.sql_around_hits(FULL, *P.OFFICE_DAYS)} AS days, {P.sql_around_hits(FULL, *P.REMOTE_HEDGED)} AS hedged FROM postings)"""
)
def work_location(spark, sf_dir):
    """Which postings suit remote and not-remote mode."""
    p = postings(spark, sf_dir)
    p, none, text = p.select("row_id", "thin", full_text(p).alias("text")), F.lit(None).cast("string"), F.col("text")
    return p.select("row_id", P.work_location(text, none, F.col("thin"), "remote").alias("keep_remote"), P.work_location(text, none, F.col("thin"), "not_remote").alias("keep_not_remote"))


@query(
    "SELECT lang, count(*) AS n, "
    + ", ".join(f"CAST(sum(CAST({V.sql_hit_by_language(sql_squeezed('description'), 'lang', s)} AS INT)) AS BIGINT) AS {s}" for s in ("remote", "senior", "posting", "no_sponsorship", "unpaid", "thesis"))
    + " FROM postings GROUP BY lang"
)
def vocabulary_hits(spark, sf_dir):
    """Postings by language that hold a term of a section, read in their language and English."""
    text = T.squeezed(F.col("description"))
    return postings(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(V.hit_by_language(text, F.col("lang"), s).cast("int")).alias(s) for s in ("remote", "senior", "posting", "no_sponsorship", "unpaid", "thesis")])


_MARKS = ", ".join(f"'{m}'" for m in V.MARKERS["en"])


@query(f"""SELECT row_id, CAST(len(w) AS INTEGER) AS n_words, len(w) < 40 OR len(list_filter(w, lambda x: x IN ({_MARKS}))) * 100 >= len(w) * 8 AS english
    FROM (SELECT row_id, list_filter(string_split_regex({sql_squeezed('description')}, '[^a-z]+'), lambda x: x <> '') AS w FROM postings)""")
def english_marker_density(spark, sf_dir):
    """English by the share of its function words."""
    words = F.filter(F.split(T.squeezed(F.col("description")), "[^a-z]+"), lambda w: w != "")
    return postings(spark, sf_dir).select("row_id", F.size(words).alias("n_words"), P.english_density(F.col("description")).alias("english"))


_COUNTS = ", ".join("{'n': len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{m}'" for m in ms) + "))), 'lang': '" + k + "'}" for k, ms in sorted(V.MARKERS.items(), reverse=True))


@query(f"""SELECT lang, detected, count(*) AS n FROM (
      SELECT lang, CASE WHEN length(trim(description)) < 40 OR best.n = 0 THEN 'unknown' ELSE best.lang END AS detected
      FROM (SELECT lang, description, list_max([{_COUNTS}]) AS best FROM (SELECT lang, description, string_split_regex({sql_squeezed('description')}, '[^\\p{{L}}]+') AS w FROM postings)))
    GROUP BY ALL""")
def language_by_function_words(spark, sf_dir):
    """Language by function words against the known one."""
    return postings(spark, sf_dir).select("lang", P.detected_language(F.col("description")).alias("detected")).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


_SUSPICIOUS = " + ".join(f"CAST(contains(lower(description), '{t}') AS INT)" for t in V.terms_of("suspicious"))


@query(f"""SELECT row_id, reasons, reasons >= 2 AS fake FROM (
      SELECT row_id, CAST(trim(company) = '' AS INT) + CAST(length(trim(description)) < 50 AND NOT thin AS INT) + CAST(trim(url) = '' AS INT) + {_SUSPICIOUS} AS reasons FROM postings)""")
def fake_two_reasons(spark, sf_dir):
    """Postings with two signs of a fake."""
    reasons = P.fake_reasons(F.col("company"), F.col("description"), F.col("url"), F.col("thin"))
    return postings(spark, sf_dir).select("row_id", reasons.alias("reasons"), (reasons >= 2).alias("fake"))


_GONE = V.sql_hit(f"substr({sql_squeezed('description')}, 1, {P.GONE_CHARS})", "gone")
_TAG = P.TAG.replace("'", "''")


_INDEX = f"(len(regexp_extract_all(description, '{_TAG}')) >= {P.INDEX_TAGS} OR regexp_matches(substr(lower(description), 1, {P.INDEX_CHARS}), '{P.INDEX_PHRASE}'))"


@query(f"""SELECT row_id, {_GONE} AS notice, {_INDEX} AS index_text,
      {_GONE} OR {_INDEX} AS gone,
      len(regexp_extract_all(lower(description), '{V.pattern_of(V.terms_of('posting'))}')) >= 3 AS posting_words FROM postings""")
def gone_and_index_text(spark, sf_dir):
    """Notices that a posting is gone, index texts, postings' own words."""
    d = F.col("description")
    return postings(spark, sf_dir).select("row_id", P.says_gone(d).alias("notice"), P.is_index_text(d).alias("index_text"), P.is_gone(d).alias("gone"), P.posting_words(d).alias("posting_words"))


WANTED = ["of and", "the in", "de la", "der die"]
_FIELD = " OR ".join("(" + " AND ".join(f"regexp_matches({sql_squeezed('title')}, '{V.pattern_of([w])}')" for w in name.split()) + ")" for name in WANTED)


@query(f"SELECT row_id, title, {sql_squeezed('title')} = '' OR {_FIELD} AS in_field FROM postings")
def field_match(spark, sf_dir):
    """P20: titles that name one of the wanted fields."""
    return postings(spark, sf_dir).select("row_id", "title", P.in_field(F.col("title"), WANTED).alias("in_field"))


@query("SELECT country, platform, count(*) AS n FROM postings WHERE country IN ('Germany', 'Spain') AND platform IN ('', 'src0', 'src1', 'src2') GROUP BY ALL")
def place_and_choice(spark, sf_dir):
    """The strict place filter and a choice that keeps blanks."""
    p = postings(spark, sf_dir).filter(P.in_places(F.col("country"), ["Germany", "Spain"]) & P.chosen(F.col("platform"), ["src0", "src1", "src2"]))
    return p.groupBy("country", "platform").agg(F.count(F.lit(1)).alias("n"))


def _category_sql(title: str, body: str) -> str:
    names = (("Thesis", "thesis"), ("PhD", "phd"), ("Internship", "internship"), ("Part-Time", "part_time"))
    return "CASE " + " ".join(f"WHEN {V.sql_hit(text, s)} THEN '{n}'" for text in (title, body) for n, s in names) + " ELSE 'Full-Time' END"


_CATEGORY = _category_sql(sql_squeezed("title"), sql_squeezed("description"))
_RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(P.CATEGORIES, 1)) + f" ELSE {len(P.CATEGORIES) + 1} END"
_T = sql_squeezed("title")
_SENIORITY = f"""CASE WHEN regexp_matches({_T}, '{V.pattern_of(["lead", "head of", "principal"])}') THEN 'Lead' WHEN {V.sql_hit(_T, 'senior')} THEN 'Senior'
  WHEN regexp_matches({_T}, '{V.pattern_of(["mid-level", "intermediate"])}') THEN 'Mid' WHEN regexp_matches({_T}, '{V.pattern_of(["junior", "graduate", "entry"])}') THEN 'Junior'
  WHEN {V.sql_hit(_T, 'internship')} THEN 'Intern' ELSE 'Unspecified' END"""


def labelled(spark, sf_dir) -> DataFrame:
    p = postings(spark, sf_dir).withColumns({"text": T.squeezed(F.col("description")), "head": T.squeezed(F.col("title"))})
    return p.withColumns({
        "category": P.category(F.col("head"), F.col("text"), F.lit(""), squeezed_already=True),
        "seniority": P.seniority(F.col("title"), F.lit("")),
        "english": P.english_need(F.col("text"), F.col("lang")),
    }).drop("text", "head")


_LABELLED = f"""labelled AS (SELECT *, {_CATEGORY} AS category, {_SENIORITY} AS seniority,
  CASE WHEN other AND named THEN 'English + Other' WHEN other THEN 'Other only' ELSE 'English only' END AS english
  FROM (SELECT *, {V.sql_hit_by_language(sql_squeezed('description'), 'lang', 'language_required')} AS other, {V.sql_hit(sql_squeezed('description'), 'english')} AS named FROM postings))"""


@query(f", {_LABELLED} SELECT row_id, category, seniority, english FROM labelled")
def category_and_seniority(spark, sf_dir):
    """Labels: category, seniority and need of English."""
    return labelled(spark, sf_dir).select("row_id", "category", "seniority", "english")


@query(f", {_LABELLED} SELECT row_id, category, CAST(row_number() OVER (ORDER BY {_RANK}, CASE WHEN country = 'Spain' THEN 0 ELSE 1 END, row_id) AS BIGINT) AS place FROM labelled")
def order_search(spark, sf_dir):
    """O1: category rank, one country first, then as they came; the place of each posting.

    Postings are numbered inside ranges of the order, so that no task holds all of them.
    """
    rows = labelled(spark, sf_dir).select("row_id", "category", P.category_rank(F.col("category")).alias("r"), F.when(F.col("country") == "Spain", 0).otherwise(1).alias("c"))
    return placed(rows, ["r", "c", "row_id"]).select("row_id", "category", "place")


_FACETS = ("platform", "country", "lang", "category", "seniority", "english")


@query(f", {_LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS facet_value, count(*) AS n FROM labelled GROUP BY {c}" for c in _FACETS))
def facet_counts(spark, sf_dir):
    """A1: rows by value of six columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("facet_value")) for c in _FACETS])).alias("f")
    return labelled(spark, sf_dir).select(pairs).select("f.*").groupBy("facet", "facet_value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT string_agg(lang || ' ' || n, ', ' ORDER BY n DESC, lang) AS languages, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, count(*) AS n FROM postings GROUP BY lang)")
def language_listagg(spark, sf_dir):
    """A2: the languages with their counts in one line."""
    counts = postings(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("lang"))))
    return counts.agg(F.array_join(F.transform(parts, lambda p: F.concat(p["lang"], F.lit(" "), (-p["o"]).cast("string"))), ", ").alias("languages"), F.sum("n").alias("n"))


_REASONS = [
    ("gone", f"{_GONE} OR {_INDEX}"),
    ("place", "country IS NULL OR country NOT IN ('United Kingdom', 'Germany', 'France')"),
    ("language", V.sql_hit_by_language(sql_squeezed("description"), "lang", "language_required")),
    ("sponsorship", V.sql_hit(sql_squeezed("description"), "no_sponsorship")),
    ("unpaid", V.sql_hit(sql_squeezed("description"), "unpaid")),
    ("not English", f"NOT (len(w) < 40 OR len(list_filter(w, lambda x: x IN ({_MARKS}))) * 100 >= len(w) * 8)"),
]


def drop_reason(p: DataFrame) -> DataFrame:
    """``p`` with the first rule that drops a posting, or null; the text is made ready once for all rules."""
    text = F.col("text")
    rules = [
        ("gone", P.says_gone(text, squeezed_already=True) | P.is_index_text(F.col("description"))),
        ("place", ~P.in_places(F.col("country"), ["United Kingdom", "Germany", "France"])),
        ("language", V.hit_by_language(text, F.col("lang"), "language_required")),
        ("sponsorship", V.hit(text, "no_sponsorship")),
        ("unpaid", V.hit(text, "unpaid")),
        ("not English", ~P.english_density(text, squeezed_already=True)),
    ]
    out = F.when(F.lit(False), F.lit(""))
    for name, test in rules:
        out = out.when(test, name)
    return p.withColumn("text", T.squeezed(F.col("description"))).withColumn("drop_reason", out)


_CHAIN = f"""chain AS (SELECT *, CASE {' '.join(f"WHEN {test} THEN '{name}'" for name, test in _REASONS)} END AS drop_reason
  FROM (SELECT *, list_filter(string_split_regex({sql_squeezed('description')}, '[^a-z]+'), lambda x: x <> '') AS w FROM postings))"""


@query(f", {_CHAIN} SELECT row_id, drop_reason FROM chain")
def drop_reason_chain(spark, sf_dir):
    """Every posting with the first rule that drops it."""
    p = postings(spark, sf_dir)
    return drop_reason(p).select("row_id", "drop_reason")


@query(f", {_CHAIN} SELECT coalesce(drop_reason, 'kept') AS reason, country, count(*) AS n FROM chain GROUP BY ALL")
def removals_by_reason(spark, sf_dir):
    """A3: postings by first reason and country."""
    p = postings(spark, sf_dir)
    return drop_reason(p).select("country", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).groupBy("reason", "country").agg(F.count(F.lit(1)).alias("n"))


_BITS = [("remote", V.sql_hit(FULL, "remote")), ("posting", V.sql_hit(FULL, "posting")), ("english", f"len(w) < 40 OR len(list_filter(w, lambda x: x IN ({_MARKS}))) * 100 >= len(w) * 8"), ("thick", "NOT thin")]


@query(f"""SELECT s AS subset, count(*) AS survivors FROM (SELECT {' + '.join(f"CASE WHEN {t} THEN {1 << k} ELSE 0 END" for k, (_, t) in enumerate(_BITS))} AS m
      FROM (SELECT *, list_filter(string_split_regex({sql_squeezed('description')}, '[^a-z]+'), lambda x: x <> '') AS w FROM postings)) JOIN (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS s) ON (m & s) = s GROUP BY s""")
def subset_survivors(spark, sf_dir):
    """How many postings survive every subset of four conditions, from the counts of their combinations."""
    p = postings(spark, sf_dir)
    tests = [V.hit(full_text(p), "remote"), V.hit(full_text(p), "posting"), P.english_density(F.col("description")), ~F.col("thin")]
    mask = sum(F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests))
    seen = p.select(mask.alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    subsets = F.explode(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: s.bitwiseAND(F.col("m")) == s)).alias("subset")
    return seen.select(subsets, "n").groupBy("subset").agg(F.sum("n").alias("survivors"))


@query(
    """, parts AS (SELECT '0x' || substr(sha256(coalesce(row_id::VARCHAR, '') || chr(31) || title || chr(31) || company || chr(31) || description), 1, 12) AS h FROM postings)
    SELECT count(*) AS n, sha256(count(*) || ':' || coalesce(CAST(sum(h::BIGINT) AS HUGEINT), 0)) AS fingerprint FROM parts"""
)
def pool_fingerprint_of_postings(spark, sf_dir):
    """A hash of the pool that no order of its rows changes."""
    return pool_fingerprint(postings(spark, sf_dir), ["row_id", "title", "company", "description"])


@query(
    r"""SELECT row_id, substr(regexp_replace(description, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), 1, 32700) || CASE WHEN length(description) > 32700 THEN ' [cut]' ELSE '' END AS cell,
      upper(substr(platform, 1, 1)) || substr(platform, 2) AS shown_platform FROM postings"""
)
def export_projection(spark, sf_dir):
    """K5: cells for export: control characters become spaces, cells that are too long are cut with a note."""
    d = F.col("description")
    cell = F.concat(F.substring(F.regexp_replace(d, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), 1, 32700), F.when(F.length(d) > 32700, " [cut]").otherwise(""))
    return postings(spark, sf_dir).select("row_id", cell.alias("cell"), F.concat(F.upper(F.substring("platform", 1, 1)), F.substring("platform", 2, 100)).alias("shown_platform"))


_PLACES = sorted(V.PLACES.items())


@query(
    "SELECT row_id, CASE WHEN len(c) = 1 THEN c[1] END AS named_country FROM (SELECT row_id, list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(description), '{V.pattern_of([p.lower()])}') THEN '{c}' END" for p, c in _PLACES)
    + "], lambda x: x IS NOT NULL)) AS c FROM postings)"
)
def single_country_from_text(spark, sf_dir):
    """The country of the places that a text names, if it is one."""
    text = F.lower(F.col("description"))
    named = F.array_distinct(F.filter(F.array(*[F.when(text.rlike(V.pattern_of([p.lower()])), F.lit(c)) for p, c in _PLACES]), lambda x: x.isNotNull()))
    return postings(spark, sf_dir).select("row_id", F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1))).alias("named_country"))



@query()
def dedup_text_greedy_postings(spark, sf_dir):
    """Greedy removal of postings with like titles and like bodies."""
    p = postings(spark, sf_dir)
    rows = p.select(F.col("row_id").alias("id"), T.dedup_title_key(F.col("title")).alias("title_key"), F.col("description").alias("body"), F.lit(1).alias("q1"), F.length("description").alias("q2"), F.lit(1).alias("q3"))
    return dedup_text_greedy(rows).select("id", "title_key", "q2")


@query()
def twins_greedy_suppliers(spark, sf_dir):
    """Parts offered under one brand and type, like names on different lines, the best stays."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.company_key(F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("company_key"), T.title_head(F.col("p_name")).alias("head"), F.lit("").alias("host"), F.lit(None).cast("string").alias("country"), F.col("p_retailprice").alias("price"))
    ranked = p.withColumn("rank", F.struct((-F.col("price")).alias("a"), "id"))
    return greedy(ranked, twin_edges(ranked)).select("id", "company_key", "head")


@query(
    """SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2000-06-01 05:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age,
      epoch(o_orderdate) >= epoch(TIMESTAMP '2000-06-01 05:00:00') - 365 * 86400 AS in_window,
      floor((epoch(TIMESTAMP '2000-06-01 05:00:00') - epoch(o_orderdate)) / 86400) <= 365 AS not_stale FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 05:00:00'""",
    with_postings=False,
)
def age_and_windows(spark, sf_dir):
    """Age in days, and the two date filters that differ at their edge."""
    now = F.lit("2000-06-01 05:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").cast("timestamp") <= now)
    posted = posted_at(F.date_format("o_orderdate", "d.M.yyyy"), now)
    return rows.select("o_orderkey", age_days(posted, now).alias("age"), within_window(posted, now, 365).alias("in_window"), not_stale(posted, now, 365).alias("not_stale"))


_RULES = (("hedged", P.only_hedged_remote, P.REMOTE_HEDGED), ("other_language", P.asks_other_language, P.OTHER_LANGUAGE), ("office_days", P.asks_office_days, P.OFFICE_DAYS), ("years", P.asks_years, P.MANY_YEARS))
#: Documents are invented prose: sentences of postings are put to some of them, by their number.
SENTENCES = ("fully remote after probation, up to 3 days a week in the office.", "fluent german is a must, english is a plus.", "fluent german. 3 days per week in the office.", "5+ years of experience required.", "4 years old company, remote possible after a year.", "")


def with_sentences(p: DataFrame) -> DataFrame:
    return p.withColumn("description", F.concat("description", F.lit(" "), F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("row_id") % len(SENTENCES) + 1).cast("int"))))


_SAID = f"said AS (SELECT * REPLACE (description || ' ' || {list(SENTENCES)}[row_id % {len(SENTENCES)} + 1] AS description) FROM postings)"


@query(f", {_SAID} SELECT lang, " + ", ".join(f"CAST(count_if({P.sql_around_hits(sql_squeezed('description'), *rule)}) AS BIGINT) AS {name}" for name, _, rule in _RULES) + " FROM said GROUP BY lang")
def sentence_rules(spark, sf_dir):
    """Rules that look around each hit, by language."""
    p = with_sentences(postings(spark, sf_dir)).select("lang", T.squeezed(F.col("description")).alias("text"))
    p = p.select("lang", *[test(F.col("text")).alias(name) for name, test, _ in _RULES])
    return p.groupBy("lang").agg(*[F.count_if(F.col(name)).alias(name) for name, *_ in _RULES])
