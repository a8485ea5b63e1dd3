"""Registered queries over pages and the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions.html import json_ld_posting, main_text
from siftmill.functions.similarity import block_ratio
from siftmill.functions.text import first_present
from siftmill.operators import joins as J
from siftmill.operators import predicates as P
from siftmill.operators.links import link_shapes, url_prefixes
from siftmill.operators.ordering import placed_within
from siftmill.operators.survivorship import first_wins
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


def one(c: str) -> str:
    return c.replace("'", "''")


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.city'), ''), nullif(json_extract_string(props, '$.k'), ''), event_type) AS location FROM events")
def norm_nested_location(spark, sf_dir):
    """The first present of several nested paths, else another field."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", first_present(F.get_json_object("props", "$.city"), F.get_json_object("props", "$.k"), F.col("event_type")).alias("location"))


@query("SELECT source, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY source")
def explode_search_pages(spark, sf_dir):
    """An item's list of results as rows, counted by source."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N') DESC, (l_linestatus = 'O') DESC, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"""
)
def best_attempt(spark, sf_dir):
    """Of several attempts the best: known status, status good, longest; here an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")
    order = [F.col("l_returnflag") != "N", F.col("l_linestatus") != "O", -F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return first_wins(lines, F.col("l_orderkey"), order, keep_blank=False).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def sitemap_locs(spark, sf_dir):
    """The addresses that a page or map names."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT url, min(n_nationkey) AS n_nationkey FROM (SELECT n_nationkey, 'https://' || d || '/search?q=' || t || '&l=' || lower(n_name) AS url
      FROM nation, (SELECT unnest(['jobs.example.org', 'work.example.net']) AS d), (SELECT unnest(['data+engineer', 'analyst']) AS t)) GROUP BY url"""
)
def site_tasks_product(spark, sf_dir):
    """Addresses for every place, site and term, each once."""
    sites, terms = (F.array(*map(F.lit, x)) for x in (["jobs.example.org", "work.example.net"], ["data+engineer", "analyst"]))
    tasks = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(sites).alias("site")).select("*", F.explode(terms).alias("term"))
    return tasks.select("n_nationkey", F.format_string("https://%s/search?q=%s&l=%s", "site", "term", F.lower("n_name")).alias("url")).groupBy("url").agg(F.min("n_nationkey").alias("n_nationkey"))


@query("SELECT DISTINCT trim(regexp_replace(s_name, '#.*', '')) || ' ' || s_nationkey AS name, (SELECT count(*) FROM supplier) >= 5 AS enough FROM supplier")
def register_distinct(spark, sf_dir):
    """A register's distinct names, and whether it is large enough to be trusted."""
    s = table(spark, sf_dir, "supplier")
    enough = s.agg((F.count(F.lit(1)) >= 5).alias("enough"))
    names = s.select(F.concat_ws(" ", F.trim(F.regexp_replace("s_name", "#.*", "")), F.col("s_nationkey").cast("string")).alias("name")).distinct()
    return names.join(F.broadcast(enough))


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, ts, event_id) AS rn
      FROM (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS batch FROM events)) WHERE rn = 1"""
)
def pool_upsert_first_wins(spark, sf_dir):
    """New rows are put before the old ones and the first of each key stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    edge = F.lit("2024-01-15").cast("timestamp")
    both = e.filter(F.col("ts") >= edge).withColumn("batch", F.lit(0)).unionByName(e.filter(F.col("ts") < edge).withColumn("batch", F.lit(1)))
    return first_wins(both, F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), [F.col("batch"), F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def html_strip(spark, sf_dir):
    """B1: the text between tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
_PAGE = "regexp_replace(url, '[?#].*$', '')"
_IDENTITY = f"regexp_replace(regexp_replace(lower({_PAGE}), '/+$', ''), '(://[^/]+)/(?:en|de|fr|es|it|nl)(/|$)', '\\1\\2')"


@query(f"SELECT page_id, {_HOST} AS host, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS no_fragment, {_PAGE} AS page, {_IDENTITY} AS same_page, lower(trim(url)) AS exact FROM pages")
def url_normalisers(spark, sf_dir):
    """The host and the four ways to normalise an address."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(u).alias("host"), T.url_without_fragment(u).alias("no_fragment"), T.url_page(u).alias("page"), T.url_identity(u).alias("same_page"), T.url_exact(u).alias("exact"))


_LOWPAGE = "lower(regexp_replace(url, '[?#].*$', ''))"
_SLUG = f"regexp_extract({_LOWPAGE}, '/([^/]+)/?$', 1)"
_SINGLE = f"""CASE WHEN regexp_matches(lower(url), '{P.ID_PARAMETER}') OR regexp_matches({_LOWPAGE}, '/\\d{{4,}}(?:/|$)') THEN true WHEN regexp_matches({_LOWPAGE}, '{P.LIST_END}') THEN false
  WHEN regexp_matches({_SLUG}, '^[0-9a-f]{{8,}}$|-\\d{{4,}}$') THEN true ELSE regexp_matches({_SLUG}, '^[^-]+(?:-[^-]+){{3,}}$') AND NOT contains({_SLUG}, 'jobs') END"""
_TITLE = "trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\s+', ' ', 'g'))"


@query(
    f"""SELECT page_id, {_SINGLE} AS single, CASE WHEN regexp_matches({_TITLE}, '{one(P.COUNTED_TITLE)}') THEN true WHEN {_SINGLE} THEN false ELSE regexp_matches({_LOWPAGE}, '{P.LIST_END}') END AS listing,
      CASE WHEN regexp_matches({_LOWPAGE}, '{P.JOB_PATH}') THEN false ELSE regexp_matches({_LOWPAGE}, '{P.EDITORIAL_PATH}') OR regexp_matches({_TITLE}, '{P.EDITORIAL_TITLE}') END AS editorial,
      regexp_matches({_TITLE}, '^\\d{{3}}$') OR (length(html) < 1200 AND (regexp_matches(lower(html), '{P.BLOCKED}') OR regexp_matches({_TITLE}, '{P.BLOCKED}'))) AS error_page FROM pages"""
)
def page_kinds(spark, sf_dir):
    """Postings, listing pages, editorial pages and error pages."""
    u, title = F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", P.is_single_posting(u).alias("single"), P.is_listing_page(u, title).alias("listing"), P.is_editorial(u, title).alias("editorial"), P.is_error_page(title, F.col("html")).alias("error_page"))


@query(f"SELECT page_id, {' OR '.join(f'regexp_matches(url, {chr(39)}{T.glob_pattern(g)}{chr(39)})' for g in ('https://*.example.com/**', 'http://**/en/*'))} AS hit FROM pages")
def glob_match(spark, sf_dir):
    """Addresses that match a glob."""
    return table(spark, sf_dir, "pages").select("page_id", P.matches_glob(F.col("url"), ["https://*.example.com/**", "http://**/en/*"]).alias("hit"))


@query(
    f"""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY {_IDENTITY} ORDER BY (NOT contains({_HOST}, 'blog')) DESC, length(html) DESC, page_id) AS rn FROM pages) WHERE rn = 1"""
)
def dedup_url_best_copy(spark, sf_dir):
    """Of pages with one address the best copy: no republisher, the longest, the first."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"))
    order = [T.url_host(F.col("url")).contains("blog"), -F.col("n"), F.col("page_id")]
    return first_wins(p, T.url_identity(F.col("url")), order).select("page_id", "url")


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY host ORDER BY n DESC, host LIMIT 6")
def top_hosts(spark, sf_dir):
    """A4: the six hosts with the most pages."""
    return table(spark, sf_dir, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(6)


@query(
    """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages),
    s AS (SELECT host, path, string_split(trim(path, '/'), '/') AS seg FROM p WHERE trim(path, '/') <> ''),
    x AS (SELECT host, unnest([1, 2]) AS depth, seg FROM s), y AS (SELECT depth, array_to_string(seg[1:depth], '/') AS prefix, len(seg) AS n_seg FROM x WHERE len(seg) >= depth),
    z AS (SELECT prefix, depth, n_seg, count(*) AS n FROM y GROUP BY ALL)
    SELECT prefix, CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS support, CAST(max_by(n_seg, (n, n_seg)) AS INTEGER) AS usual_depth FROM z GROUP BY prefix, depth HAVING sum(n) >= 2"""
)
def url_prefix_support(spark, sf_dir):
    """Prefixes of one and two segments with the addresses below them."""
    return url_prefixes(table(spark, sf_dir, "pages").select("url")).filter("support >= 2").select("prefix", "depth", "support", "usual_depth")


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
    g AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '\\d+', '0', 'g'), '[^/0]+', 'a', 'g') AS shape, count(DISTINCT href) AS links FROM l GROUP BY ALL)
    SELECT page_id, shape, links FROM g WHERE links >= 3"""
)
def link_groups(spark, sf_dir):
    """Links of a page grouped by the shape of their address, groups of three and more."""
    return link_shapes(table(spark, sf_dir, "pages"), least=3)


@query(
    """SELECT c_custkey, n_name AS country, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE trim(regexp_replace(lower(regexp_replace(c_name, '#.*', '')), '[^a-z]+', ' ', 'g')) || c_nationkey IN (SELECT 'customer' || s_nationkey FROM supplier)"""
)
def register_exact_semi(spark, sf_dir):
    """J5, exact part: employers whose normalised name stands in their country's register."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", T.company_norm(F.regexp_replace("c_name", "#.*", "")).alias("name"))
    register = table(spark, sf_dir, "supplier").select(F.lit("customer").alias("name"), F.col("s_nationkey").alias("c_nationkey")).distinct()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), "n_regionkey")
    return c.join(register, ["name", "c_nationkey"], "left_semi").join(n, "c_nationkey").select("c_custkey", "country", "n_regionkey")


@query()
def register_fuzzy(spark, sf_dir):
    """J5, fuzzy part: distinct names that are nearly those of the register, in a band of lengths."""
    names = table(spark, sf_dir, "part").select(T.company_norm(F.col("p_name")).alias("name")).distinct()
    register = table(spark, sf_dir, "part").select(T.company_norm(F.regexp_replace("p_name", "^([a-z]+) ", "$1s ")).alias("legal")).distinct()
    return J.fuzzy_register(names, register, "name", "legal", block_ratio, 0.90)


@query(
    """SELECT o.o_orderkey, coalesce(c.c_name, 'unknown') AS legal_name, c.c_acctbal > 0 AS good FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'"""
)
def legal_name_lookup(spark, sf_dir):
    """Names from a table of known ones, ``unknown`` where it has none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return o.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("legal_name"), (F.col("c_acctbal") > 0).alias("good"))


@query(
    """SELECT e.event_id, coalesce(p.event_id, f.first_id) AS parent_id FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'purchase') p ON p.event_id = e.event_id - 1
      LEFT JOIN (SELECT user_id, min(event_id) AS first_id FROM events WHERE event_type = 'purchase' GROUP BY user_id) f ON f.user_id = e.user_id
      WHERE e.event_type <> 'purchase' AND coalesce(p.event_id, f.first_id) IS NOT NULL"""
)
def parent_or_domain(spark, sf_dir):
    """A child's parent by its referrer, else the first of its domain; children without a parent go."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    parents, children = e.filter("event_type = 'purchase'"), e.filter("event_type <> 'purchase'")
    return J.parent_or_first(children, parents, F.col("event_id") - 1, "event_id", "user_id").select("event_id", "parent_id")


@query(
    """SELECT n.n_name, count(c.c_custkey) AS n_found, CAST(count_if(c.c_acctbal < 0) AS BIGINT) AS n_wrong, CASE WHEN count(c.c_custkey) = 0 THEN 'unreachable' WHEN count_if(c.c_acctbal >= 0) = 0 THEN 'wrong only' ELSE 'found' END AS status
      FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'MACHINERY' GROUP BY n.n_name"""
)
def task_counts(spark, sf_dir):
    """What each task found, with a status for those that found nothing."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(F.col("c_acctbal") < 0).alias("n_wrong"))
    out = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_found", "n_wrong")])
    return out.withColumn("status", F.when(F.col("n_found") == 0, "unreachable").when(F.col("n_found") == F.col("n_wrong"), "wrong only").otherwise("found"))


_DOMAINS = ["example.com", "blog.example.com", "example.org", "m.example.net"]


@query(
    f"""SELECT page_id, domain FROM (SELECT page_id, d AS domain, row_number() OVER (PARTITION BY page_id ORDER BY length(d) DESC) AS rn
      FROM (SELECT page_id, {_HOST} AS host FROM pages) JOIN (SELECT unnest({_DOMAINS}) AS d) ON host = d OR ends_with(host, '.' || d)) WHERE rn = 1"""
)
def domain_suffix_join(spark, sf_dir):
    """Pages with the longest known domain that their host ends with, by an equi-join on the host's suffixes."""
    known = spark.createDataFrame([(d,) for d in _DOMAINS], "domain string")
    return J.by_domain_suffix(table(spark, sf_dir, "pages").select("page_id", "url"), known, "page_id", T.url_host(F.col("url")))


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def quiet_sites_anti(spark, sf_dir):
    """Expected sites that nothing was found on."""
    found = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return table(spark, sf_dir, "nation").join(found, "n_nationkey", "left_anti").select("n_name")


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS pos FROM pages),
    n AS (SELECT page_id, href, min(pos) AS pos FROM l WHERE href NOT IN ('/the', '/of', '/and') GROUP BY ALL)
    SELECT page_id, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM n) WHERE rn <= 3"""
)
def new_links_cap(spark, sf_dir):
    """Of each page the first few links that are not known yet."""
    known = spark.createDataFrame([("/the",), ("/of",), ("/and",)], "href string")
    return J.new_links(table(spark, sf_dir, "pages"), known, 3)


@query(
    """WITH k AS (SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS latest FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
    SELECT e.event_id, k.latest, k.latest IS NOT NULL AS hit FROM events e LEFT JOIN k USING (user_id, event_type) WHERE e.ts >= TIMESTAMP '2024-01-20'"""
)
def verdict_cache_hit(spark, sf_dir):
    """The latest cached verdict for each row's content key, and whether there was one."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.concat_ws("|", F.lit("v1"), F.col("user_id").cast("string"), "event_type"), 256).alias("key"))
    edge = F.lit("2024-01-20").cast("timestamp")
    return J.cached_verdicts(e.filter(F.col("ts") >= edge), e.filter(F.col("ts") < edge), "key", "event_id").select("event_id", "latest", "hit")


@query(
    """SELECT u.conv_id, u.turn, u.text AS asked, a.text AS answered FROM conversations u LEFT JOIN (SELECT conv_id, turn, any_value(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL HAVING count(*) = 1) a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'"""
)
def answers_reassoc(spark, sf_dir):
    """Answers go back to their questions by key, never by position; ambiguous ones are not used."""
    c = table(spark, sf_dir, "conversations")
    return J.reassociated(c.filter("role = 'user'"), c.filter("role = 'assistant'"))


@query("SELECT item_id, doc_id FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS q FROM benchmark) b JOIN (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM documents) d ON length(q) >= 6 AND contains(t, q)")
def evidence_contained(spark, sf_dir):
    """Which documents hold a quote word for word, letters and digits only; a hashed window finds candidates."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", T.alnum_only(F.col("text")).alias("q"))
    texts = table(spark, sf_dir, "documents").select("doc_id", T.alnum_only(F.col("text")).alias("t"))
    return J.containing(quotes, texts)


@query(
    """SELECT strftime(ts, '%Y-%m') AS month, event_type AS model, count(*) AS calls, round(sum(value * CASE WHEN starts_with(event_type, 'pur') THEN 3 WHEN starts_with(event_type, 'c') THEN 1.25 ELSE 0.5 END), 4) AS usd FROM events GROUP BY ALL"""
)
def spend_by_month(spark, sf_dir):
    """Spend by month and model, priced by the first prefix that fits."""
    price = F.when(F.col("event_type").startswith("pur"), 3.0).when(F.col("event_type").startswith("c"), 1.25).otherwise(0.5)
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value") * price), 4).alias("usd"))


@query("SELECT count(*) AS n, CAST(count_if(quality = 1) AS BIGINT) AS keep, CAST(count_if(quality = 0) AS BIGINT) AS drop_, CAST(count_if(toxic = 1) AS BIGINT) AS flagged, CAST(count_if(quality = 1 AND toxic = 1) AS BIGINT) AS kept_by_user FROM labels")
def verdict_counts(spark, sf_dir):
    """Verdicts by kind in one pass."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(q).alias("keep"), F.count_if(F.col("quality") == 0).alias("drop_"), F.count_if(t).alias("flagged"), F.count_if(q & t).alias("kept_by_user"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Processing' WHEN 'F' THEN 'Accept' ELSE 'Reject' END AS status, CASE WHEN isfinite(o_totalprice) THEN o_totalprice END AS total,
      CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders"""
)
def application_status(spark, sf_dir):
    """K1, K4 and O2: statuses mapped, numbers that are none as null, ordered best first within a status."""
    o = table(spark, sf_dir, "orders")
    total = F.when(~F.isnan("o_totalprice") & (F.abs("o_totalprice") != float("inf")), F.col("o_totalprice"))
    status = F.when(F.col("o_orderstatus") == "O", "Processing").when(F.col("o_orderstatus") == "F", "Accept").otherwise("Reject")
    rows = o.select("o_orderkey", "o_orderstatus", status.alias("status"), total.alias("total"), (-F.col("o_totalprice")).alias("by"))
    return placed_within(rows, ["o_orderstatus"], "by", "o_orderkey").select("o_orderkey", "status", "total", "place")


@query("SELECT event_type, count(*) AS n FROM events WHERE value IS NULL OR value >= 20 GROUP BY event_type")
def match_floor(spark, sf_dir):
    """Rows of at least a score; rows without one stay."""
    return table(spark, sf_dir, "events").filter(P.reaches(F.col("value"), 20)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size IN (1, 2, 3, 11) GROUP BY ALL")
def facet_filter(spark, sf_dir):
    """Ticks of two columns together; a column without ticks filters nothing."""
    p = table(spark, sf_dir, "part")
    for column, ticks in (("p_brand", ["Brand#1", "Brand#2"]), ("p_size", [1, 2, 3, 11]), ("p_type", [])):
        p = p.filter(F.col(column).isin(ticks)) if ticks else p
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, greatest(0, 500 - count(*)) AS remaining, count(*) < 500 AS allowed FROM events GROUP BY user_id")
def budget_gate(spark, sf_dir):
    """What is left of a budget, and whether more may be asked."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return used.select("user_id", F.greatest(F.lit(0), 500 - F.col("n")).alias("remaining"), (F.col("n") < 500).alias("allowed"))


@query("SELECT c_custkey, CAST(least(100, greatest(0, CAST(floor(c_acctbal / 100) AS BIGINT))) AS BIGINT) AS similarity, CASE WHEN c_acctbal >= 8000 THEN 'high' WHEN c_acctbal >= 5000 THEN 'medium' ELSE 'low' END AS band FROM customer")
def score_bands(spark, sf_dir):
    """O3: scores clamped to 0 to 100, and their bands."""
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("similarity"), F.when(F.col("c_acctbal") >= 8000, "high").when(F.col("c_acctbal") >= 5000, "medium").otherwise("low").alias("band"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' GmbH & Co. KG'), '[./]', '', 'g'), '[^a-z0-9]+', ' ', 'g').string_split(' ').list_filter(lambda w: w NOT IN ('gmbh', 'co', 'kg', '')).array_to_string(' ') AS norm FROM part")
def company_names(spark, sf_dir):
    """Company names without legal forms."""
    return table(spark, sf_dir, "part").select("p_partkey", T.company_norm(F.concat("p_name", F.lit(" GmbH & Co. KG"))).alias("norm"))


@query()
def html_main_text(spark, sf_dir):
    """The readable text of a page, its structured description first."""
    return table(spark, sf_dir, "pages").select("page_id", main_text(F.col("html")).alias("text"), json_ld_posting(F.col("html")).alias("posting"))
