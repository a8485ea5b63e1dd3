"""Registered queries over single steps of a search: titles, places, pages of answers, levels, settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import places, titles
from siftmill.functions import text as T
from siftmill.functions import vocabulary as V
from siftmill.operators import levels, paging
from siftmill.operators import predicates as P
from siftmill.operators.links import glob_cover
from siftmill.operators.ordering import placed
from siftmill.plans import posting_queries as PQ
from siftmill.plans import table_queries as TQ
from siftmill.plans.adapters import POSTINGS, postings, sql_squeezed
from siftmill.sources.registers import current_version
from siftmill.sources.sinks import upserted
from siftmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(number, *values):
    """One of the values in turn."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\|(?:\s*[^\s|]+){{1,3}}\s*$', ' ', 'g'),
  '\(?\b[mfwd]\s*/\s*[mfwd](?:\s*/\s*[mfwdx])?\b\)?', ' ', 'g'), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[€$£]?\s*\d[\d.,]*\s*(?:k|eur|usd|gbp)?', ' ', 'g'), '[^a-zÀ-ɏ ]+', ' ', 'g'), ' +', ' ', 'g'))"""


@query(
    f"""WITH {POSTINGS}, n AS (SELECT row_id, platform || ' labs' AS name, [lower(title) || ' at ' || platform || ' labs', platform || ' labs - ' || lower(title), lower(title) || ' | ' || platform || ' labs (m/w/d)', lower(title)][row_id % 4 + 1] AS t FROM postings)
    SELECT row_id, {_KEY.format(t=r"regexp_replace(t, '\s*(?:\b(?:at|bij|chez|presso)\b|@|[-–,|])?\s*' || regexp_escape(name) || '\b\.?', ' ', 'g')")} AS title_key FROM n"""
)
def title_keys_without_employer(spark, sf_dir):
    """Keys of titles that name their employer in four ways."""
    p = postings(spark, sf_dir)
    name = F.concat("platform", F.lit(" Labs"))
    title = pick(F.col("row_id"), F.concat("title", F.lit(" at "), name), F.concat(name, F.lit(" - "), "title"), F.concat("title", F.lit(" | "), name, F.lit(" (m/w/d)")), F.col("title"))
    return p.select("row_id", T.dedup_title_key(title, name).alias("title_key"))


_TOLD_CATEGORY = " OR ".join(V.sql_hit(sql_squeezed(c), s) for c in ("title", "description") for s in ("thesis", "phd", "internship", "part_time"))


@query(
    f"""WITH {POSTINGS} SELECT row_id, coalesce(nullif(CASE WHEN row_id % 11 = 0 THEN ' ' ELSE {PQ._CATEGORY} END, ' '), 'Other') || CASE WHEN row_id % 7 = 0 THEN ' Startup' ELSE '' END AS shown,
      NOT ({_TOLD_CATEGORY}) AND row_id % 5 <> 0 AND coalesce(lang, 'unknown') NOT IN ('en', 'unknown') AS uncertain FROM postings"""
)
def category_shown(spark, sf_dir):
    """Categories as shown, and whether nothing told them."""
    p = postings(spark, sf_dir)
    category = F.when(F.col("row_id") % 11 == 0, " ").otherwise(P.category(F.col("title"), F.col("description"), F.lit("")))
    stage, employment = F.when(F.col("row_id") % 7 == 0, "startup"), F.when(F.col("row_id") % 5 == 0, "Contract").otherwise("")
    return p.select("row_id", P.shown_category(category, stage).alias("shown"), P.category_uncertain(F.col("title"), F.col("description"), employment, F.col("lang")).alias("uncertain"))


@query(
    f"""WITH {POSTINGS}, {PQ._LABELLED}, u AS (SELECT row_id, category, country, CASE WHEN NOT ({_TOLD_CATEGORY}) AND row_id % 5 <> 0 AND coalesce(lang, 'unknown') NOT IN ('en', 'unknown') THEN {len(P.CATEGORIES) + 2} ELSE {PQ._RANK} END AS r FROM labelled)
    SELECT row_id, r AS rank, row_number() OVER (ORDER BY r, CASE WHEN country = 'Spain' THEN 0 ELSE 1 END, row_id) AS place FROM u"""
)
def order_search_certain_first(spark, sf_dir):
    """The order of a search with those postings last whose category nothing told."""
    p = PQ.labelled(spark, sf_dir)
    employment = F.when(F.col("row_id") % 5 == 0, "Contract").otherwise("")
    uncertain = P.uncertain_of(F.col("category"), employment, F.col("lang"))
    rank = F.when(uncertain, len(P.CATEGORIES) + 2).otherwise(P.category_rank(F.col("category")))
    rows = p.select("row_id", rank.alias("rank"), F.when(F.col("country") == "Spain", 0).otherwise(1).alias("c"))
    return placed(rows, ["rank", "c", "row_id"]).select("row_id", "rank", "place")


_HINTS = " ".join(f"WHEN regexp_matches(lower(text), '{places.gazetteer_pattern(c)}') THEN '{c}'" for c in places.GAZETTEER)


@query(f"SELECT lang, country, count(*) AS n FROM (SELECT lang, CASE {_HINTS} END AS country FROM documents) GROUP BY ALL")
def hinted_countries(spark, sf_dir):
    """The country that a text names."""
    return table(spark, sf_dir, "documents").select("lang", places.hinted_country(F.col("text")).alias("country")).groupBy("lang", "country").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT lang, "
    + ", ".join(f"CAST(count_if({' OR '.join(f'contains(t, {chr(39)}{s}{chr(39)})' for s in ss)}) AS BIGINT) AS {c.lower()}" for c, ss in places.CITIES.items())
    + f" FROM (SELECT lang, lower(text || ' ' || ['in München', 'WIEN', 'near Torino', 'Oslo', ''][doc_id % 5 + 1]) AS t FROM documents) GROUP BY lang"
)
def cities_mentioned(spark, sf_dir):
    """Texts that name a city in any of its spellings."""
    d = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(" "), pick(F.col("doc_id"), "in München", "WIEN", "near Torino", "Oslo", ""))
    return d.select("lang", text.alias("t")).groupBy("lang").agg(*[F.count_if(places.mentions_city(c, F.col("t"))).alias(c.lower()) for c in places.CITIES])


_TERM = """'"data engineer" ' || ['Oslo', 'Germany site:berlinstartupjobs.com', 'new milan area', '', 'nowhere'][doc_id % 5 + 1] || CASE WHEN doc_id % 2 = 0 THEN ' site:amsterdam.example' ELSE '' END"""
_SLOT = places.PLACE_SLOT.replace("'", "''")


@query(
    f"""WITH t AS (SELECT doc_id, {_TERM} AS term FROM documents), s AS (SELECT doc_id, lower(coalesce(nullif(regexp_extract(term, '{_SLOT}', 1), ''), term)) AS low FROM t)
    SELECT doc_id, CASE {' '.join(f"WHEN contains(low, '{n.lower()}') THEN '{k}'" for k, ns in (('city', places.CITIES), ('country', places.COUNTRIES)) for n in ns)} END AS kind,
      CASE {' '.join(f"WHEN contains(low, '{n.lower()}') THEN '{n}'" for ns in (places.CITIES, places.COUNTRIES) for n in ns)} END AS place FROM s"""
)
def places_of_terms(spark, sf_dir):
    """The place that a search term asks for, never one in a site's name."""
    d = table(spark, sf_dir, "documents")
    term = F.concat(F.lit('"data engineer" '), pick(F.col("doc_id"), "Oslo", "Germany site:berlinstartupjobs.com", "new milan area", "", "nowhere"), F.when(F.col("doc_id") % 2 == 0, " site:amsterdam.example").otherwise(""))
    return d.select("doc_id", places.place_of_term(term).alias("p")).select("doc_id", "p.kind", "p.place")


_ENDS = ("Engineering", "engineer", "DEVELOPMENT", "data scientist", "Science", "DevOps", "neuroscience")
_E = f"{list(_ENDS)}[p_partkey % {len(_ENDS)} + 1]"


@query(
    f"""SELECT p_partkey, 'x ' || e AS role, f AS field, forms FROM (SELECT p_partkey, ['Engineer', 'engineer', 'DEVELOPER', 'data scientist', 'Scientist', 'DevOps', 'neuroscience'][k] AS e,
      'x ' || ['Engineering', 'engineering', 'DEVELOPMENT', 'data science', 'Science', 'DevOps', 'neuroscience'][k] AS f,
      ['x Engineering|x Engineer', 'x engineer|x engineering', 'x DEVELOPMENT|x DEVELOPER', 'x data scientist|x data science', 'x Science|x Scientist', 'x DevOps', 'x neuroscience'][k] AS forms
      FROM (SELECT p_partkey, CAST(p_partkey % 7 + 1 AS INTEGER) AS k FROM part))"""
)
def title_twins(spark, sf_dir):
    """The forms of a title: for the person, for the subject, and both."""
    t = F.concat(F.lit(' x  "'), pick(F.col("p_partkey"), *_ENDS), F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", titles.role_form(t).alias("role"), titles.field_form(t).alias("field"), F.array_join(titles.title_forms(t), "|").alias("forms"))


@query(f"WITH {POSTINGS} SELECT platform, country, lang, count(*) AS n FROM postings GROUP BY GROUPING SETS ((platform), (country), (platform, lang))")
def counts_by_platform_and_task(spark, sf_dir):
    """A5: rows by platform, by country, and by platform and language in one pass."""
    p = postings(spark, sf_dir).select("platform", "country", "lang")
    return p.groupingSets([["platform"], ["country"], ["platform", "lang"]], "platform", "country", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POSTINGS} SELECT platform, array_to_string(list_sort(list(DISTINCT country)), ',') AS countries, bool_or(thin) AS any_thin, bool_and(NOT thin) AS all_thick FROM postings GROUP BY platform")
def sets_by_platform(spark, sf_dir):
    """A10: the set of countries of a platform, and whether any or all of its rows have a property."""
    p = postings(spark, sf_dir).groupBy("platform")
    return p.agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), F.bool_or("thin").alias("any_thin"), F.bool_and(~F.col("thin")).alias("all_thick"))


@query("SELECT user_id, CASE WHEN bool_or(event_id % 40 = 0) THEN NULL ELSE max(event_id % 40) END AS window_days, min(event_id % 40) AS least FROM events GROUP BY user_id")
def widest_settings(spark, sf_dir):
    """The widest of several windows; one of 0 has no bound."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("d")).groupBy("user_id")
    return e.agg(F.when(F.bool_or(F.col("d") == 0), None).otherwise(F.max("d")).alias("window_days"), F.min("d").alias("least"))


def _listed(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


_GLOBS = ("http*://*.example.com/**", "https://*.example.org/*/*", "**/en/*", "ftp://**")


@query(
    f"""WITH g AS (SELECT unnest([{_listed(_GLOBS)}]) AS proposed, unnest([{_listed(map(T.glob_pattern, _GLOBS))}]) AS pattern), u AS (SELECT url, {TQ._SINGLE} AS candidate FROM pages)
    SELECT proposed, count(*) AS matched, CAST(count_if(NOT candidate) AS BIGINT) AS others, count_if(NOT candidate) <= 2 AND count_if(candidate) >= 2 AS usable FROM u JOIN g ON regexp_matches(url, pattern) GROUP BY proposed"""
)
def glob_coverage(spark, sf_dir):
    """What each glob covers, and how many addresses besides postings."""
    return glob_cover(table(spark, sf_dir, "pages").select("url"), list(_GLOBS), P.is_single_posting(F.col("url"))).withColumnRenamed("glob", "proposed")


_ANSWERS = "SELECT event_type, event_id, user_id, CAST(1 + event_id % 31 + CASE WHEN event_id % 31 > 12 AND event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS page, event_id AS pos FROM events"


def answers(spark, sf_dir) -> DataFrame:
    """Events as answers of sources page by page; one source lacks a page."""
    page = F.col("event_id") % 31
    return table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", (1 + page + F.when((page > 12) & (F.col("event_type") == "view"), 1).otherwise(0)).cast("int").alias("page"), F.col("event_id").alias("pos"))


@query(
    f"""WITH a AS ({_ANSWERS}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY page, pos) AS rn FROM a WHERE page <= 20) WHERE rn = 1),
    g AS (SELECT event_type, page, row_number() OVER (PARTITION BY event_type ORDER BY page) AS k FROM (SELECT DISTINCT event_type, page FROM f)),
    r AS (SELECT f.*, row_number() OVER (PARTITION BY f.event_type ORDER BY f.page, f.pos) AS n FROM f JOIN g ON f.event_type = g.event_type AND f.page = g.page AND g.k = g.page)
    SELECT event_type, user_id, event_id FROM r WHERE n <= 100"""
)
def pages_until_nothing_new(spark, sf_dir):
    """What reading page by page collects before it stops."""
    return paging.read_until_nothing_new(answers(spark, sf_dir), "event_type", "user_id", most_rows=100).select("event_type", "user_id", "event_id")


@query(f"WITH a AS ({_ANSWERS}) SELECT event_type, page, count(*) AS n FROM (SELECT *, min(page) OVER (PARTITION BY event_type, user_id) AS first FROM a) WHERE page = first GROUP BY ALL")
def pages_against_earlier(spark, sf_dir):
    """Rows that no earlier page has; repeats inside a page stay."""
    return paging.new_against_earlier_pages(answers(spark, sf_dir), "event_type", "user_id").groupBy("event_type", "page").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT event_id // 10 AS batch, bool_or(value > 60 AND event_id % 10 < 4) AS done FROM events GROUP BY ALL)
    SELECT event_id AS url, CASE WHEN done THEN 'batch' WHEN value > 20 THEN 'single' ELSE 'failed' END AS outcome FROM events JOIN b ON b.batch = event_id // 10"""
)
def batches_with_retry(spark, sf_dir):
    """Batches are tried four times, failed ones are split into their urls."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.floor(F.col("event_id") / 10).alias("batch"))
    attempts = e.select("batch", (F.col("event_id") % 10 + 1).alias("attempt"), (F.col("value") > 60).alias("ok"))
    return paging.crawled(attempts, e.select(F.col("event_id").alias("url"), "batch", (F.col("value") > 20).alias("ok"))).select("url", "outcome")


_LEVELS = tuple(levels.TOO_MANY)
_YEARS = ("At least 5+ years of experience required.", "We look for 1-2 years of experience.", "Minimum 4 years required. No rush", "7 years of experience, not required", "Guests aged 18 to 28 years.", "A plan for 2 years", "")


@query(
    f"""WITH {POSTINGS}, t AS (SELECT *, ['', 'Internship', 'Director'][row_id % 3 + 1] AS field FROM (SELECT * REPLACE (description || ' ' || {list(_YEARS)}[row_id % {len(_YEARS)} + 1] AS description) FROM postings))
    SELECT row_id, {', '.join(f"{levels.sql_wrong_level('title', 'description', 'field', level)} AS {level}" for level in _LEVELS)} FROM t"""
)
def levels_of_postings(spark, sf_dir):
    """Postings for another level than the one looked for, for four levels."""
    body = F.concat("description", F.lit(" "), pick(F.col("row_id"), *_YEARS))
    field = pick(F.col("row_id"), "", "Internship", "Director")
    return postings(spark, sf_dir).select("row_id", *[levels.wrong_level(F.col("title"), body, field, level).alias(level) for level in _LEVELS])


@query(f"WITH {POSTINGS} SELECT row_id, NOT thin AND coalesce(lang, 'unknown') NOT IN ('en', 'unknown', '') AND NOT {V.sql_hit('t', 'english')} AS silent FROM (SELECT *, {sql_squeezed('description')} || CASE WHEN row_id % 3 = 0 THEN ' englisch' ELSE '' END AS t FROM postings)")
def silent_postings(spark, sf_dir):
    """Postings in another language that never name English."""
    text = F.concat(T.squeezed(F.col("description")), F.when(F.col("row_id") % 3 == 0, " englisch").otherwise(""))
    return postings(spark, sf_dir).select("row_id", P.silent_about_english(text, F.col("lang"), F.col("thin")).alias("silent"))


@query(
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id) AS rn FROM events)
    SELECT user_id, event_id FROM u WHERE rn = 1 AND event_type <> 'purchase'"""
)
def pool_edits(spark, sf_dir):
    """K2: new rows are put before the pool's, then some are deleted."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("row_id"), "event_type")
    pool = upserted(e.filter("row_id % 2 = 0"), e.filter("row_id % 2 = 1"))
    return pool.filter("event_type <> 'purchase'").select(F.col("url").cast("long").alias("user_id"), F.col("row_id").alias("event_id"))


@query(
    """WITH r AS (SELECT c_nationkey, c_name, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 60) AS fetched FROM customer), m AS (SELECT c_nationkey, max(fetched) AS fetched FROM r GROUP BY c_nationkey)
    SELECT r.c_nationkey AS country, r.c_name AS name, r.fetched < TIMESTAMP '2024-03-20' - INTERVAL 30 DAY AS stale FROM r JOIN m USING (c_nationkey, fetched)"""
)
def register_versions(spark, sf_dir):
    """Each country's latest version of a register, and whether it is too old."""
    c = table(spark, sf_dir, "customer")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 60).cast("int"))
    r = c.select(F.col("c_nationkey").alias("country"), F.col("c_name").alias("name"), at.alias("fetched_at"))
    return current_version(r, "2024-03-20 00:00:00").select("country", "name", "stale")


_SITEMAP = "'<urlset><url><loc> ' || url || ' </loc></url><url><loc>http://a.org/jobs/' || page_id || '</loc></url></urlset>'"


@query(f"SELECT page_id, loc, regexp_matches(loc, '{P.JOB_PATH}') AS jobs FROM (SELECT page_id, unnest(regexp_extract_all({_SITEMAP}, '<loc>\\s*([^<]*?)\\s*</loc>', 1)) AS loc FROM pages)")
def sitemap_entries(spark, sf_dir):
    """The addresses in a site map, and which look like postings."""
    xml = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc></url><url><loc>http://a.org/jobs/"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>"))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("loc"))
    return found.withColumn("jobs", F.col("loc").rlike(P.JOB_PATH))


@query(f"WITH {POSTINGS} SELECT row_id, sha256(d || n) AS noted, CASE WHEN n <> '' THEN 'reason ' || row_id ELSE '' END AS note, sha256(d) AS restored FROM (SELECT row_id, regexp_replace(description, '\\s+$', '') AS d, CASE WHEN row_id % 2 = 0 THEN chr(10) || '$$ reason ' || row_id || ' $$' ELSE '' END AS n FROM postings)")
def drop_notes(spark, sf_dir):
    """Notes of a removal are added once, read, and taken off again."""
    reason = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("reason "), F.col("row_id").cast("string")))
    once = T.drop_note_added(F.regexp_replace("description", r"\s+$", ""), F.lit("an older reason"))
    p = postings(spark, sf_dir).select("row_id", T.drop_note_added(once, reason).alias("t"))
    return p.select("row_id", F.sha2("t", 256).alias("noted"), T.drop_note_of(F.col("t")).alias("note"), F.sha2(T.drop_note_removed(F.col("t")), 256).alias("restored"))


@query(f"SELECT page_id, contains({TQ._HOST}, 'example.org') OR contains({TQ._HOST}, 'blog') AS excluded FROM pages")
def excluded_boards(spark, sf_dir):
    """Pages on boards that are left out."""
    return table(spark, sf_dir, "pages").select("page_id", P.on_board(F.col("url"), ["example.org", "blog"]).alias("excluded"))


@query(
    """SELECT page_id, CASE WHEN length(k) >= 3 AND n > 1 THEN k ELSE t END AS title FROM (SELECT page_id, t, len(s) AS n, array_to_string(list_filter(s, lambda x, i: NOT (regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') = 'exampleboard' AND (i = 1 OR i >= len(s) - 1))), ' - ') AS k
      FROM (SELECT page_id, t, string_split_regex(t, ' [|–-] ') AS s FROM (SELECT page_id, ['Example Board | ', '', 'a - '][page_id % 3 + 1] || regexp_extract(html, '<title>([^<]*)</title>', 1) || [' - Example Board', ' | Example-Board – en', ''][page_id % 3 + 1] AS t FROM pages)))"""
)
def titles_without_site(spark, sf_dir):
    """Titles without the name of their site."""
    k = F.col("page_id")
    t = F.concat(pick(k, "Example Board | ", "", "a - "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), pick(k, " - Example Board", " | Example-Board – en", ""))
    return table(spark, sf_dir, "pages").select("page_id", T.site_tail_removed(t, F.lit("example board")).alias("title"))
