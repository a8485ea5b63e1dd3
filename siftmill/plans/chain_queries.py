"""Registered queries over whole chains: sources, filter, modules, reviewers, dates and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions import vocabulary as V
from siftmill.functions.dates import MONTHS, posted_at
from siftmill.operators.links import proposed_globs
from siftmill.operators.survivorship import module_dedup
from siftmill.operators import predicates as P
from siftmill.plans import posting_queries as PQ
from siftmill.plans import table_queries as TQ
from siftmill.plans.adapters import POSTINGS, postings, sql_squeezed
from siftmill.plans.chains import Choices, accounted, accounting_with_copies, cleaned_up, filtered, module_reason, module_search, screened
from siftmill.plans.posting_queries import with_sentences
from siftmill.sources.normalise import COLUMNS, SOURCES, WORKPLACES, normalised
from siftmill.streaming.ingest import arrivals, collect_into, first_of_each, with_undated
from siftmill.tables import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CHOICES = Choices(mode="not_remote", countries=("United Kingdom", "Germany", "France"), sponsorship=("Yes",), fields=("of", "the", "der", "de"), days=45, floor=20)


def asked(spark, sf_dir) -> DataFrame:
    """Postings with what their sources would tell besides: a date, a sponsorship, a score, and sentences of postings."""
    day = F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("row_id") % 60).cast("int")).cast("string")
    sponsor = F.element_at(F.array(F.lit(""), F.lit("Yes"), F.lit("No")), (F.col("row_id") % 3 + 1).cast("int"))
    return with_sentences(postings(spark, sf_dir)).withColumns({"workplace": F.lit(None).cast("string"), "sponsorship": sponsor, "posted_raw": day, "score": (F.col("row_id") % 100).cast("int")})


def _chain_sql() -> str:
    full, text = PQ.FULL, sql_squeezed("description")
    field = " OR ".join("(" + " AND ".join(f"regexp_matches({sql_squeezed('title')}, '{V.pattern_of([w])}')" for w in name.split()) + ")" for name in CHOICES.fields)
    page = "lower(regexp_replace(url, '[?#].*$', ''))"
    rules = [
        ("field", f"NOT ({sql_squeezed('title')} = '' OR {field})"),
        ("fake", f"CAST(trim(company) = '' AS INT) + CAST(length(trim(description)) < 50 AND NOT thin AS INT) + CAST(trim(url) = '' AS INT) + {PQ._SUSPICIOUS} >= 2"),
        ("place", "country IS NULL OR country NOT IN ('United Kingdom', 'Germany', 'France')"),
        ("sponsorship choice", "sponsorship NOT IN ('', 'Yes')"),
        ("match", "score < 20"),
        ("gone", f"{PQ._GONE} OR {PQ._INDEX}"),
        ("editorial", f"CASE WHEN regexp_matches({page}, '{P.JOB_PATH}') THEN false ELSE regexp_matches({page}, '{P.EDITORIAL_PATH}') OR regexp_matches({sql_squeezed('title')}, '{P.EDITORIAL_TITLE}') END"),
        ("date", "posted_days > 45"),
        ("work location", f"NOT ({V.sql_hit(full, 'not_remote')} OR {V.sql_hit(full, 'on_site')} OR thin OR NOT {V.sql_hit(full, 'remote')})"),
        ("silent about English", f"NOT thin AND coalesce(lang, 'unknown') NOT IN ('en', 'unknown', '') AND NOT {V.sql_hit(full, 'english')}"),
        ("language", f"{V.sql_hit_by_language(full, 'lang', 'language_required')} OR {P.sql_around_hits(full, *P.OTHER_LANGUAGE)}"),
        ("no sponsorship", V.sql_hit(full, "no_sponsorship")),
        ("unpaid", V.sql_hit(full, "unpaid")),
    ]
    return f"""WITH {POSTINGS}, {PQ._SAID}, told AS (SELECT *, ['', 'Yes', 'No'][row_id % 3 + 1] AS sponsorship, row_id % 60 AS posted_days, row_id % 100 AS score,
        row_number() OVER (PARTITION BY {text} ORDER BY length(description) DESC, row_id) AS copy_no FROM said),
      reasons AS (SELECT CASE WHEN copy_no > 1 AND {text} <> '' THEN 'copy' {' '.join(f"WHEN {test} THEN '{name}'" for name, test in rules)} ELSE 'kept' END AS reason FROM told)
      SELECT reason, count(*) AS n FROM reasons GROUP BY reason"""


@query(_chain_sql())
def filter_chain(spark, sf_dir):
    """Best copies and every rule of the filter, its removals counted by the first that applies."""
    return accounting_with_copies(asked(spark, sf_dir), CHOICES)


@query()
def filter_whole(spark, sf_dir):
    """C1 to its end: best copies, rules, greedy removal of like postings, order of the result."""
    return filtered(asked(spark, sf_dir), Choices(countries=("United Kingdom", "Germany", "France"), days=45, floor=20)).select("row_id", "score", "category_order")


@query()
def filter_accounted(spark, sf_dir):
    """C1 with its twins: what becomes of every posting, copies, rules, like ones and twins in one account."""
    rows = asked(spark, sf_dir).withColumn("url", F.when(F.col("row_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://mirror.example.org/p/"), F.col("row_id").cast("string"))))
    return accounted(rows, Choices(countries=("United Kingdom", "Germany", "France"), days=45, floor=20))


_TEXT = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _cleanup_sql() -> str:
    posting = f"len(regexp_extract_all(lower(body), '{V.pattern_of(V.terms_of('posting'))}')) >= 3"
    index = f"(len(regexp_extract_all(body, '{PQ._TAG}')) >= {P.INDEX_TAGS} OR regexp_matches(substr(lower(body), 1, {P.INDEX_CHARS}), '{P.INDEX_PHRASE}'))"
    chrome = f"CASE WHEN trim(body) = '' THEN true WHEN {index} THEN true WHEN length(body) >= 2400 THEN false ELSE NOT {posting} END"
    gone = V.sql_hit(f"substr({sql_squeezed('body')}, 1, {P.GONE_CHARS})", "gone")
    return f"""WITH p AS (SELECT page_id, url, html, {TQ._TITLE} AS title, {_TEXT} || ' Apply now. Requirements and salary.' AS body, page_id % 50 AS age,
        CASE WHEN regexp_matches({TQ._TITLE}, '{TQ.one(P.COUNTED_TITLE)}') THEN true WHEN {TQ._SINGLE} THEN false ELSE regexp_matches({TQ._LOWPAGE}, '{P.LIST_END}') END AS is_list FROM (SELECT page_id, html, CASE WHEN page_id % 9 = 0 THEN regexp_replace(url, '[?#].*$', '') || '/jobs/' ELSE url END AS url FROM pages)),
      f AS (SELECT * FROM p WHERE age <= 30),
      l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS pos FROM f WHERE is_list),
      n AS (SELECT page_id, href, min(pos) AS pos FROM l WHERE href NOT IN ('/the', '/of') AND href NOT IN (SELECT url FROM p) GROUP BY ALL),
      x AS (SELECT href, min(page_id) AS found_on FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM n) WHERE rn <= 3 GROUP BY href)
      SELECT url, CAST(length(body) AS INTEGER) AS n_chars, CAST(NULL AS BIGINT) AS found_on FROM f WHERE NOT is_list AND NOT ({gone} OR {index}) AND NOT ({chrome})
      UNION ALL SELECT href, 0, found_on FROM x"""


@query(_cleanup_sql())
def search_cleanup(spark, sf_dir):
    """Stale pages go, index pages are replaced by their links, pages that are gone or hold furniture only go."""
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 9 == 0, F.concat(T.url_page(F.col("url")), F.lit("/jobs/"))).otherwise(F.col("url"))
    posted = F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("page_id") % 50).cast("int"))
    body = F.concat(T.strip_html(F.col("html")), F.lit(" Apply now. Requirements and salary."))
    rows = p.select("page_id", url.alias("url"), "html", T.squeezed(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), body.alias("body"), posted.alias("posted"))
    known = spark.createDataFrame([("/the",), ("/of",)], "url string")
    return cleaned_up(rows, known, "2024-02-01 00:00:00", 30, most_links=3).select("url", F.length("body").alias("n_chars"), "found_on")


def _nested(values: dict[str, object]) -> object:
    """Columns by JSON path as one struct: $.a.b[0].c is a field c in the first of a list b in a."""
    tree: dict = {}
    for path, value in values.items():
        at = tree
        keys = path.removeprefix("$.").split(".")
        for key in keys[:-1]:
            at = at.setdefault(key, {})
        at[keys[-1]] = value

    def build(node):
        if not isinstance(node, dict):
            return node
        fields = []
        for key, below in node.items():
            name, bracket, _ = key.partition("[")
            made = build(below)
            fields.append((F.array(made) if bracket else made).alias(name))
        return F.struct(*fields)

    return build(tree)


#: What the columns of a source hold in the queries below, in Spark and as SQL; the text comes with mark-up around it.
_TOLD = {
    "title": (lambda: F.concat(F.lit("Job "), F.col("doc_id").cast("string")), "'Job ' || doc_id"),
    "company": (lambda: F.col("source"), "source"),
    "location": (lambda: F.col("lang"), "lang"),
    "country": (lambda: F.concat(F.lit("in "), F.col("lang")), "'in ' || lang"),
    "posted_raw": (lambda: F.concat(F.lit("published on the day number "), F.col("n_chars").cast("string")), "'published on the day number ' || n_chars"),
    "url": (lambda: F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")), "'http://x/' || doc_id"),
    "description": (lambda: F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")), "trim(regexp_replace(regexp_replace('<p>' || text || '</p>', '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g'))"),
    "employment_type": (lambda: F.lit("FULL TIME, permanent"), "'Full-time'"),
    "workplace_type": (lambda: F.lit("hybrid work"), "'Hybrid'"),
}


def _source_query(name: str) -> None:
    source = SOURCES[name]
    given = {c: source.paths[c] for c in COLUMNS if c in source.paths and c not in source.fixed}
    every = [p for paths in given.values() for p in paths]
    # a path that others continue cannot hold a text as well, and one that columns share is given by the first of them
    given = {c: [p for p in paths if not any(q.startswith(p + ".") for q in every)] for c, paths in given.items()}
    lent = {c: paths for c, paths in given.items() if any(p in others for p in paths for o, others in given.items() if list(given).index(o) < list(given).index(c))}
    given = {c: paths for c, paths in given.items() if c not in lent}

    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents")
        # documents take turns at the paths of a column, some leave all but the address out, some answers are broken
        values = {path: F.when((F.col("doc_id") % len(paths) == k) & ((F.col("doc_id") % 10 != 3) | F.lit(c == "url")), _TOLD[c][0]()) for c, paths in given.items() for k, path in enumerate(paths)}
        item = _nested(values | ({source.needs: _TOLD["url"][0]()} if source.needs else {}))
        whole = F.array(item) if source.items.endswith("[*]") else item
        for key in reversed([p for p in source.items.removesuffix("[*]").removeprefix("$").split(".") if p]):
            whole = F.struct(whole.alias(key))
        raw = d.select(F.when(F.col("doc_id") % 17 == 0, F.lit("{broken")).otherwise(F.to_json(whole)).alias("item"))
        out = normalised(raw, source).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS], "platform", "thin", F.col("problem").isNotNull().alias("problem"))
        return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))

    def sql_value(c: str) -> str:
        if c in source.fixed:
            return f"'{WORKPLACES.get(source.fixed[c], source.fixed[c])}' AS {c}"
        if c in lent:  # read where its own path is empty, as here, from the column that it shares one with
            c, name = next(o for o in given if set(given[o]) & set(lent[c])), c
            return sql_value(c).removesuffix(f" AS {c}") + f" AS {name}"
        left_out = "false" if c == "url" else "doc_id % 10 = 3"
        return f"CASE WHEN doc_id % 17 = 0 OR {left_out} THEN '' ELSE coalesce({_TOLD[c][1]}, '') END AS {c}" if c in given else f"'' AS {c}"

    run.__name__ = f"source_{name}"
    run.__doc__ = f"S1 to S9: payloads of {name} as rows of the common schema; broken ones are told apart, none is lost."
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"""SELECT *, count(*) AS n FROM (SELECT {', '.join(map(sql_value, COLUMNS))}, '{name}' AS platform, {str(source.thin).lower()} AS thin, doc_id % 17 = 0 AS problem FROM documents) GROUP BY ALL"""


for _name in SOURCES:
    _source_query(_name)


_FULL = f"{sql_squeezed('title')} || ' ' || {sql_squeezed('description')}"
_MARKS = ", ".join(f"'{m}'" for m in V.MARKERS["en"])


def _module_sql(kind: str) -> str:
    english = f"len(w) < 40 OR len(list_filter(w, lambda x: x IN ({_MARKS}))) * 100 >= len(w) * 8"
    return f"""CASE WHEN NOT {V.sql_hit(_FULL, kind)} THEN 'no {kind}' WHEN {V.sql_hit(sql_squeezed('title'), 'phd')} AND NOT {V.sql_hit(sql_squeezed('title'), kind)} THEN 'phd'
      WHEN {V.sql_hit(_FULL, 'on_site')} AND NOT {V.sql_hit(_FULL, 'remote')} THEN 'on site' WHEN {V.sql_hit(_FULL, 'unpaid')} THEN 'unpaid' WHEN NOT ({english}) THEN 'not English' END"""


@query(
    f"""WITH {POSTINGS}, w AS (SELECT *, list_filter(string_split_regex({sql_squeezed('description')}, '[^a-z]+'), lambda x: x <> '') AS w FROM postings)
    SELECT lang, {_module_sql('thesis')} AS thesis, {_module_sql('internship')} AS internship, count(*) AS n FROM w GROUP BY ALL"""
)
def module_reasons(spark, sf_dir):
    """Why a posting is none for the thesis and internship searches."""
    p = postings(spark, sf_dir)
    return p.select("lang", module_reason("thesis").alias("thesis"), module_reason("internship").alias("internship")).groupBy("lang", "thesis", "internship").agg(F.count(F.lit(1)).alias("n"))


@query()
def module_duplicates(spark, sf_dir):
    """Greedy removal by sorted words of the title."""
    rows = postings(spark, sf_dir).select(F.col("row_id").alias("id"), "title", F.col("description").alias("body"), F.lit(1).alias("q1"), F.length("description").alias("q2"), F.lit(1).alias("q3"))
    return module_dedup(rows).select("id", "title")


_SQUEEZE = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(
    f"""WITH {POSTINGS} SELECT p.row_id, coalesce(l.quality = 0 AND length(q) >= 6 AND contains({_SQUEEZE.format('p.title')} || {_SQUEEZE.format('p.company')} || {_SQUEEZE.format('p.description')}, q), false) AS screen_drop
    FROM postings p LEFT JOIN (SELECT doc_id, any_value(quality) AS quality, any_value({_SQUEEZE.format("CASE WHEN toxic = 1 THEN 'nobody wrote this ' || doc_id ELSE 'src' || (doc_id % 20) || ' ltd' END")}) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = p.row_id"""
)
def reviewer_verdicts(spark, sf_dir):
    """A reviewer's removals count only with a quote that stands in the posting."""
    quote = F.when(F.col("toxic") == 1, F.concat(F.lit("nobody wrote this "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit(" ltd")))
    verdicts = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("row_id"), (F.col("quality") == 0).alias("drop"), quote.alias("quote"))
    return screened(postings(spark, sf_dir), verdicts).select("row_id", "screen_drop")


@query()
def module_search_whole(spark, sf_dir):
    """C4: the internship search as one chain over all postings, a third of which are offers of internships."""
    p = postings(spark, sf_dir)
    offered = p.withColumn("title", F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("Internship "), "title")).otherwise(F.col("title")))
    quote = F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit(" ltd"))
    verdicts = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("row_id"), (F.col("quality") == 0).alias("drop"), quote.alias("quote"))
    return module_search(offered, "internship", verdicts)


@query("SELECT o_orderkey, o_orderdate AS posted FROM orders")
def date_ladder(spark, sf_dir):
    """Dates written in eight ways are read as the days that they mean."""
    d = F.col("o_orderdate").cast("timestamp")
    ways = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_timestamp(d).cast("string"), F.date_format(d, "d.M.yyyy"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMM d, yyyy"), F.concat(F.lit("posted on "), F.date_format(d, "dd MMMM, yyyy")), F.concat(F.lit("until "), F.date_format(d, "yyyy-MM-dd"), F.lit(" only"))]
    raw = F.element_at(F.array(*ways), (F.col("o_orderkey") % 8 + 1).cast("int"))
    # an epoch of under nine digits is no date for the ladder: those rows are given as ISO dates
    raw = F.when(raw.rlike(r"^-?\d{1,8}$"), ways[0]).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", posted_at(raw, F.lit("2024-01-01").cast("timestamp")).alias("posted"))


@query("SELECT o_orderkey, o_orderdate AS posted FROM orders")
def dates_in_words(spark, sf_dir):
    """Days with the month's name in twelve languages, in four orders, are read as the days that they mean."""
    d = F.col("o_orderdate").cast("timestamp")
    names = F.array(*[F.array(*map(F.lit, months)) for months in MONTHS.values()])
    month = F.element_at(F.element_at(names, (F.col("o_orderkey") % len(MONTHS) + 1).cast("int")), F.month(d))
    day, year = F.day(d).cast("string"), F.year(d).cast("string")
    ways = [F.concat_ws(" ", day, month, year), F.concat(day, F.lit(". "), month, F.lit(" "), year), F.concat(month, F.lit(" "), day, F.lit(", "), year), F.concat(F.lit("id 7, "), day, F.lit(" de "), month, F.lit(" de "), year, F.lit(", 100 %"))]
    raw = F.element_at(F.array(*ways), (F.floor(F.col("o_orderkey") / len(MONTHS)) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", posted_at(raw, F.lit("2024-01-01").cast("timestamp")).alias("posted"))


#: Ages as boards of twelve languages write them, with the days of their units.
AGES = (
    ("%s days ago", 1), ("vor %s Wochen", 7), ("il y a %s jours", 1), ("hace %s meses", 30), ("%s settimane fa", 7), ("%s dagen geleden", 1), ("há %s dias", 1),
    ("för %s veckor sedan", 7), ("for %s måneder siden", 30), ("%s uger siden", 7), ("%s päivää sitten", 1), ("%s tygodni temu", 7), ("Posted 30+ days ago", 0), ("gestern", 0), ("vor einer Woche", 0), ("Dzisiaj", 0),
)
#: The days of the ages without a number.
FIXED_AGES = {12: 30, 13: 1, 14: 7, 15: 0}


@query(
    f"""SELECT o_orderkey, TIMESTAMP '2024-02-01 12:00:00' - to_days(CAST(CASE o_orderkey % {len(AGES)} {' '.join(f'WHEN {k} THEN {days}' for k, days in FIXED_AGES.items())}
      ELSE (o_orderkey % 97 + 2) * ([{', '.join(str(days) for _, days in AGES)}])[o_orderkey % {len(AGES)} + 1] END AS INTEGER)) AS posted FROM orders"""
)
def ages_in_words(spark, sf_dir):
    """Ages in words of twelve languages are read as the time that they mean."""
    key = F.col("o_orderkey")
    phrase = F.element_at(F.array(*[F.lit(p) for p, _ in AGES]), (key % len(AGES) + 1).cast("int"))
    raw = F.replace(phrase, F.lit("%s"), (key % 97 + 2).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", posted_at(raw, F.lit("2024-02-01 12:00:00").cast("timestamp")).alias("posted"))


@query(
    """WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages),
    s AS (SELECT string_split(trim(path, '/'), '/') AS seg FROM p WHERE trim(path, '/') <> ''),
    x AS (SELECT unnest([1, 2]) AS depth, seg FROM s), z AS (SELECT depth, array_to_string(seg[1:depth], '/') AS prefix, len(seg) AS n_seg, count(*) AS n FROM x WHERE len(seg) >= depth GROUP BY ALL),
    u AS (SELECT prefix, depth, CAST(sum(n) AS BIGINT) AS support, max_by(n_seg, (n, n_seg)) AS usual FROM z GROUP BY prefix, depth)
    SELECT '**/' || prefix || repeat('/*', CAST(greatest(usual - depth, 1) AS BIGINT)) AS glob, support, CAST(depth AS INTEGER) AS depth FROM u WHERE support >= greatest(2, depth + 1) ORDER BY depth, support DESC, 1 LIMIT 8"""
)
def glob_proposals(spark, sf_dir):
    """Globs for a pool of addresses."""
    return proposed_globs(table(spark, sf_dir, "pages").select("url"))


@query("SELECT DISTINCT user_id || '|' || event_type AS k FROM events")
def stream_first_of_each(spark, sf_dir):
    """Collecting as a stream: every key once, whatever the batches."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("k"), F.col("ts").cast("timestamp").alias("t"))
    folder, out, state = (scratch_path(spark, name) for name in ("arrivals", "collected", "state"))
    e.write.parquet(folder)
    schema = "k string, t timestamp"
    collect_into(first_of_each(arrivals(spark, folder, schema), "k", "t", "100 days"), out, state).awaitTermination()
    return with_undated(spark.read.schema(schema).parquet(out), spark.read.schema(schema).parquet(folder), "k", "t").select("k")


@query("SELECT lang, sha256('v1' || chr(31) || lang || chr(31) || 'any') AS signature, count(*) AS n FROM documents GROUP BY lang")
def filter_signatures(spark, sf_dir):
    """D6 and the result cache: a key of the choices for each language's pool."""
    key = F.sha2(F.concat_ws("\x1f", F.lit("v1"), F.col("lang"), F.lit("any")), 256)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", key.alias("signature"), "n")


@query("SELECT page_id, CASE WHEN ends_with(url, '.md') THEN left(url, length(url) - 3) ELSE regexp_replace(url, '\\.md([?#])', '\\1') END AS address, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading FROM pages")
def mirror_url(spark, sf_dir):
    """The address behind a mark-down copy, and the heading that a missing title is taken from."""
    return table(spark, sf_dir, "pages").select("page_id", T.mirrored_address(F.col("url")).alias("address"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"))
