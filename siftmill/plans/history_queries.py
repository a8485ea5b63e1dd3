"""Registered queries over crawls, sources as partitions, tables with history, runs, settings, memory and reviews."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import cards, crawl, logs
from siftmill.sources import recorded
from siftmill.sources.history import History
from siftmill.sources.registers import register_of_years
from siftmill.sources.structured import structured_postings
from siftmill.sources.workbooks import workbook_lines, workbooks
from siftmill.streaming.verdicts import held_verdicts, never_held
from siftmill.tables import scratch_path, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    r"""WITH RECURSIVE p AS (SELECT page_id, url, '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS seg, html FROM pages),
    links AS (SELECT url AS source, unnest(list_transform(regexp_extract_all(html, 'href="(/[^"]+)"', 1), lambda h: regexp_replace(h, '[?#].*$', ''))) AS target FROM p UNION SELECT seg, url FROM p),
    reach(node, depth) AS (SELECT url, 0 FROM p WHERE page_id % 50 = 0 UNION SELECT l.target, r.depth + 1 FROM reach r JOIN links l ON l.source = r.node WHERE r.depth < 6)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY node"""
)
def pages_reached(spark, sf_dir):
    """What can be reached from every fiftieth page, over links to sections and from sections to their pages."""
    pages = table(spark, sf_dir, "pages")
    path = lambda u: F.regexp_extract(u, r"^[a-zA-Z]+://[^/]+(/[^?#]*)", 1)
    out = crawl.anchors(pages.select("url", "html")).select(F.col("url").alias("source"), path("href").alias("target"))
    section = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)).alias("source"), F.col("url").alias("target"))
    return crawl.reached(out.unionByName(section), pages.filter("page_id % 50 = 0").select(F.col("url").alias("node")), 6)


#: Addresses of a host's map that make one part of it.
MAP_PART = 10_000


@query(
    r"""WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#:]*[.]([a-z]+)', 1) AS tld FROM pages WHERE url IS NOT NULL),
    hosts AS (SELECT tld, host FROM (SELECT DISTINCT tld, host FROM p) QUALIFY row_number() OVER (PARTITION BY tld ORDER BY host) <= 6)
    SELECT tld AS site, url AS page FROM p JOIN hosts USING (tld, host) QUALIFY row_number() OVER (PARTITION BY tld ORDER BY url) <= 500"""
)
def site_map_pages(spark, sf_dir):
    """The pages behind an index of site maps, six maps of each; the maps name themselves and their index too."""
    host, tld = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#:]*[.]([a-z]+)", 1)
    p = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url", host.alias("host"), tld.alias("tld")).distinct()
    listed = lambda values: F.array_join(F.transform(F.array_sort(F.collect_set(values)), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))), "")
    own = lambda c: F.concat(F.lit("https://"), c, F.lit("/sitemap.xml"))
    index = lambda c: F.concat(F.lit("https://maps."), c, F.lit("/index"))
    # a host's map comes in parts of about MAP_PART addresses, the first of which names the map itself
    parts = p.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / MAP_PART).alias("parts"))
    parted = p.join(F.broadcast(parts), "host").withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts"))).select("host", "part", "url")
    parted = parted.unionByName(parts.select("host", F.lit(0).cast("long").alias("part"), own("host").alias("url")))
    maps = parted.groupBy("host", "part").agg(listed(F.col("url")).alias("locs")).select(own("host").alias("url"), F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("body"))
    indexes = p.groupBy("tld").agg(listed(own("host")).alias("locs")).select(index("tld").alias("url"), F.concat(F.lit("<sitemapindex>"), "locs", F.lit("<loc>"), index("tld"), F.lit("</loc></sitemapindex>")).alias("body"))
    return crawl.site_map_pages(maps.unionByName(indexes), p.select(F.col("tld").alias("site"), index("tld").alias("map")).distinct())


@query(
    """SELECT event_type AS source, CAST(event_id % 5 AS INTEGER) AS page, CAST(CASE WHEN event_type = 'error' AND event_id % 5 = 3 THEN 0 ELSE count(*) END AS BIGINT) AS items,
      event_type = 'error' AND event_id % 5 = 3 AS broken, CASE WHEN event_type = 'error' AND event_id % 5 = 3 THEN NULL ELSE CAST(sum(event_id) AS BIGINT) END AS ids
    FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY event_type, event_id % 5"""
)
def recorded_sources(spark, sf_dir):
    """Answers recorded by source and page, read by a data source of its own. One page of one source cannot be
    read: it is a problem, all others are whole; sources that are not wanted are never opened."""
    recorded.register(spark)
    path = scratch_path(spark, "recorded")
    e = table(spark, sf_dir, "events").filter("event_type IS NOT NULL").select(F.col("event_type").alias("source"), (F.col("event_id") % 5).alias("page"), F.to_json(F.struct("event_id", "value")).alias("value"))
    broken = F.when((F.col("source") == "error") & (F.col("page") == 3), F.concat(F.lit("<html>"), "value")).otherwise(F.col("value"))
    e.withColumn("value", broken).repartition("source", "page").write.partitionBy("source", "page").text(path)
    rows = spark.read.format("recorded").option("path", path).load().filter(F.col("source").isin("click", "error", "view"))
    ids = F.try_variant_get(F.try_parse_json("item"), "$.event_id", "long")
    return rows.groupBy("source", "page").agg(F.count("item").alias("items"), F.bool_or(F.col("problem").isNotNull()).alias("broken"), F.sum(ids).alias("ids"))


@query(
    """WITH s AS (SELECT user_id, least((day(ts) - 1) // 6 + 1, 5) AS part, event_type, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY ts DESC, event_id DESC) = 1),
    g AS (SELECT s.*, v.part AS seen FROM s JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS part) v ON s.part <= v.part),
    p AS (SELECT *, max(CASE WHEN event_type = 'error' THEN part ELSE 0 END) OVER (PARTITION BY user_id, seen) AS dead FROM g),
    r AS (SELECT seen, user_id, coalesce(arg_max({'e': event_type, 'v': value}, part) FILTER (event_type <> 'view'), arg_min({'e': event_type, 'v': value}, part) FILTER (event_type = 'view')) AS x FROM p WHERE part > dead GROUP BY seen, user_id)
    SELECT CAST(seen AS INTEGER) AS part, user_id, x.e AS event_type, x.v AS value FROM r"""
)
def pool_history(spark, sf_dir):
    """K2, K4, K7: five merges of a user's last event, each version read afterwards. An error deletes the user, a view
    only inserts; the third version is compacted, and a commit that was interrupted is never seen."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 6) + 1, F.lit(5)).cast("int")
    last = e.groupBy("user_id", part.alias("part")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "part", "x.*")
    history = History(spark, scratch_path(spark, "pool"), "user_id", "user_id long, event_type string, value double")
    versions = []
    for k in range(1, 6):
        source = last.filter(F.col("part") == k).select("user_id", "event_type", "value")
        versions.append((k, history.merge(source, delete=F.col("new.event_type") == "error", keep=F.col("new.event_type") == "view", note=f"part {k}")))
        if k == 3:
            history.compact()
            history.empty.select("*", F.lit(True).alias("_gone")).write.parquet(f"{history.folder.path}/data/interrupted")
    out = None
    for k, version in versions:
        rows = history.read(version).select(F.lit(k).alias("part"), "user_id", "event_type", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 8 HOUR, true) AS fresh FROM events WHERE ts IS NOT NULL),
    n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
    r AS (SELECT user_id, run, min(ts) AS started, count(*) AS events, sum(value) AS usd, row_number() OVER (PARTITION BY user_id ORDER BY min(ts) DESC) AS ago FROM n GROUP BY user_id, run)
    SELECT user_id, count(*) AS runs, strftime(max(started), '%Y-%m-%d %H:%M:%S') AS current_started, max(events) FILTER (ago = 1) AS current_events, round(max(usd) FILTER (ago = 1), 4) AS current_usd,
      max(events) FILTER (ago = 2) AS last_events, round(max(usd) FILTER (ago = 2), 4) AS last_usd, round(max(usd / events) FILTER (ago = 2), 4) AS last_usd_each, round(sum(usd), 4) AS total_usd FROM r GROUP BY user_id"""
)
def spend_runs(spark, sf_dir):
    """A6 and Money: runs of a user, parted by eight hours of quiet: the current one, the one before it, and all."""
    r = logs.runs(table(spark, sf_dir, "events"), "user_id", "ts", "8 hours", usd=F.sum("value"))
    of = lambda k, x: F.max(F.when(F.col("ago") == k, x))
    return r.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"), F.date_format(F.max("started"), "yyyy-MM-dd HH:mm:ss").alias("current_started"), of(1, F.col("events")).alias("current_events"), F.round(of(1, F.col("usd")), 4).alias("current_usd"),
        of(2, F.col("events")).alias("last_events"), F.round(of(2, F.col("usd")), 4).alias("last_usd"), F.round(of(2, F.col("usd") / F.col("events")), 4).alias("last_usd_each"), F.round(F.sum("usd"), 4).alias("total_usd"),
    )


@query(
    """SELECT event_id, sha256('{"k"="' || json_extract_string(props, '$.k') || '","tags"=[' || array_to_string(list_transform(list_sort(list_distinct(['b', event_type])), lambda t: '"' || t || '"'), ',')
      || '],"user"={"id"="' || user_id || '","name"="x \\"y\\""}}') AS signature, true AS same_shuffled, false AS same_other FROM events"""
)
def settings_signatures(spark, sf_dir):
    """Section 2.11: settings as VARIANT with one signature for all ways of writing them, and another for other settings."""
    k, kind, user = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("user_id").cast("string")
    one = F.format_string('{"k": %s, "tags": ["%s", "b", "%s", " "], "user": {"id": %s, "name": " x \\"y\\" "}, "blank": "  ", "none": null, "list": [], "inner": {"a": ""}}', k, kind, kind, user)
    two = F.format_string('{"list": [""], "user": {"name": "x \\"y\\"", "id": "%s"}, "tags": ["b", "%s"], "k": " %s "}', user, kind, k)
    other = F.format_string('{"k": %s, "tags": ["%s,b"], "user": {"id": %s, "name": "x"}}', k, kind, user)
    signature = lambda text: F.sha2(logs.canonical(F.parse_json(text)), 256)
    signed = table(spark, sf_dir, "events").select("event_id", signature(one).alias("signature"), signature(two).alias("s2"), signature(other).alias("s3"))
    return signed.select("event_id", "signature", (F.col("signature") == F.col("s2")).alias("same_shuffled"), (F.col("signature") == F.col("s3")).alias("same_other"))


_VERDICTS = "SELECT event_id, user_id, ts, CAST(event_id % 3 AS INTEGER) AS version, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS verdict FROM events"


@query(
    f"""WITH e AS ({_VERDICTS}),
    w AS (SELECT *, last_value(CASE WHEN verdict IS NOT NULL AND version >= 1 THEN {{'ts': ts, 'v': verdict}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM e)
    SELECT event_id, coalesce(ts - last.ts < INTERVAL 12 HOUR, false) AS hit, CASE WHEN ts - last.ts < INTERVAL 12 HOUR THEN last.v END AS verdict FROM w WHERE w.verdict IS NULL"""
)
def verdicts_held(spark, sf_dir):
    """Verdicts as state with a time to live; the events come as a stream of three batches."""
    verdict = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).cast("int").alias("version"), verdict.alias("verdict"))
    path, out = scratch_path(spark, "verdicts"), scratch_path(spark, "held")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # what has arrived is a batch, of any number of files; each run goes on from the state of the one before
    for k, (first, last) in enumerate(((1, 10), (11, 20), (21, 31))):
        rows.filter(F.dayofmonth("ts").between(first, last)).write.parquet(f"{path}/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/*")
        held_verdicts(stream, "12 hours", 1).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema("key string, id long, ts timestamp, hit boolean, verdict string").parquet(f"{out}/batch=*")
    return held.unionByName(never_held(rows)).select(F.col("id").alias("event_id"), "hit", "verdict")


@query(
    """WITH valid AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS v FROM events WHERE event_id % 4 >= 1),
    b AS (SELECT *, coalesce(lag(v) OVER w, '') AS before, lead(v) OVER w IS NULL AS last FROM valid WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, nullif(v, '') AS strategy, last_change AND v <> '' AS holds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last_change FROM b WHERE v <> before)"""
)
def strategy_memory(spark, sf_dir):
    """Section 2.17: what a log has taught of each user: changes only, stale versions skipped, an empty value deletes."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("strategy"), (F.col("event_id") % 4).alias("version"))
    return logs.remembered(log, "user_id", "strategy", "version", ["ts", "event_id"], 1).select("event_id", "user_id", "strategy", "holds")


def rule_reviewer(batch: pd.DataFrame) -> list[tuple[int, str]]:
    """A reviewer by rule that behaves like a service: it breaks on some rows, forgets some and answers some twice."""
    if (batch["id"] % 97 == 0).any():
        raise RuntimeError("the reviewer broke off")
    told = [(i, "keep" if len(t.split(" ")) > 200 else "short") for i, t in zip(batch["id"], batch["text"], strict=True) if i % 41 != 0]
    return told + [t for t in told if t[0] % 53 == 0 and len(batch) > 1] + [(-1, "keep")]


@query("SELECT doc_id, CASE WHEN doc_id % 97 = 0 OR doc_id % 41 = 0 THEN 'failed' WHEN len(string_split(coalesce(text, ''), ' ')) > 200 THEN 'keep' ELSE 'short' END AS answer FROM documents")
def reviewed_in_batches(spark, sf_dir):
    """L1, L3: documents in batches by a budget of characters, put to a reviewer that fails; failed batches are halved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("key"))
    return logs.reviewed(logs.batched(docs, F.length("text"), "key", 100_000), rule_reviewer).select(F.col("id").alias("doc_id"), "answer")


_NUMBERED = r"^[a-z]+://[^/]+/[a-z]+/[0-9]+$"


@query(
    rf"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#:]*[.]([a-z]+)', 1) AS site, regexp_replace(url, '[?#].*$', '') AS url FROM pages),
    s AS (SELECT site, url, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') AS s FROM p),
    d AS (SELECT * FROM (SELECT site, len(s) AS d, count(*) AS n FROM s WHERE len(s) > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, d DESC) = 1),
    l AS (SELECT site, d.n AS cards, k, s[k] AS name, count(*) AS c FROM s JOIN d USING (site), range(1, 9) r(k) WHERE len(s) = d.d AND k <= d.d GROUP BY ALL),
    m AS (SELECT site, cards, k, CASE WHEN max(c) * 100 >= cards * 90 THEN arg_max(name, {{'c': c, 'name': name}}) ELSE '*' END AS part FROM l GROUP BY site, cards, k),
    g AS (SELECT site, '**/' || string_agg(part, '/' ORDER BY k) AS proposed, cards FROM m GROUP BY site, cards HAVING cards >= 3 AND arg_max(part, k) = '*'),
    nav AS (SELECT DISTINCT site, '**/about/*' AS proposed, 4 AS cards FROM p), every AS (SELECT * FROM g UNION ALL SELECT * FROM nav),
    hit AS (SELECT e.site, e.proposed, count(*) AS matched, count_if(NOT regexp_matches(p.url, '{_NUMBERED}')) AS others FROM every e JOIN p ON p.site = e.site AND regexp_full_match(p.url, replace(replace(replace(e.proposed, '**', '#'), '*', '[^/]*'), '#', '.*')) GROUP BY ALL)
    SELECT e.site, e.proposed, CAST(e.cards AS BIGINT) AS cards, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(coalesce(others, 0) AS BIGINT) AS others, coalesce(others, 0) <= 2 AND coalesce(matched, 0) - coalesce(others, 0) >= 2 AS usable
    FROM every e LEFT JOIN hit h USING (site, proposed)"""
)
def patterns_discovered(spark, sf_dir):
    """From list pages made of each site's addresses, among menus and adverts, to the globs of its postings."""
    tld, bare = F.regexp_extract("url", r"^[a-z]+://[^/?#:]*[.]([a-z]+)", 1), F.regexp_replace("url", "[?#].*$", "")
    urls = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select(tld.alias("site"), bare.alias("url")).distinct()
    # a list page for each address's share of its site, with its cards, one menu and a lone advert
    share = F.pmod(F.xxhash64("url"), F.lit(16))
    card = F.concat(F.lit("<div class='card n"), share.cast("string"), F.lit("'><h2><a href="), "url", F.lit(">x</a></h2><br></div>"))
    menu = "".join(f'<li class="m{k}"><a href="/about/{x}">{x}</a>' for k, x in enumerate(("us", "team", "press", "jobs")))
    lists = urls.groupBy("site", share.alias("share")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    html = F.concat(F.lit(f"<html><body><ul class='menu'>{menu}</ul><!-- <a href='/no'> --><div class=list>"), "cards", F.lit("</div><p><a href='/ad/1'>ad</a></body></html>"))
    pages = lists.select("site", F.concat(F.lit("https://list."), "site", F.lit("/page")).alias("url"), html.alias("html"))
    return cards.discovered(pages, urls.withColumn("candidate", F.col("url").rlike(_NUMBERED)), "site").withColumnRenamed("glob", "proposed")


@query("SELECT c_nationkey, c_custkey, c_name, c_mktsegment FROM customer")
def exported_workbooks(spark, sf_dir):
    """Customers as workbooks of each nation, at most 200 rows in one, and their cells read again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    books = stored(workbooks(c, ["c_custkey"], ("c_nationkey",), most=200), "workbooks")
    lines = workbook_lines(books.withColumn("path", F.col("c_nationkey").cast("string"))).filter("row > 1")
    return lines.select(F.col("path").cast(c.schema["c_nationkey"].dataType).alias("c_nationkey"), F.col("cells")[0].cast(c.schema["c_custkey"].dataType).alias("c_custkey"), F.col("cells")[1].alias("c_name"), F.col("cells")[2].alias("c_mktsegment"))


#: The columns of a register's files, year by year.
YEARS = {2021: ("Employer", "Town"), 2022: ("Fiscal Year", " employer "), 2023: ("Petitioner", "Employer Name", "x")}


@query(
    """SELECT name, CAST(min(y) AS INTEGER) AS first_year, CAST(max(y) AS INTEGER) AS last_year, count(DISTINCT y) AS years FROM (
      SELECT trim(c_mktsegment || ', ' || (c_custkey % 1000)) AS name, unnest(CASE c_custkey % 4 WHEN 0 THEN [2021] WHEN 1 THEN [2022, 2023] WHEN 2 THEN [2021, 2023] ELSE [2022] END) AS y FROM customer) GROUP BY name"""
)
def register_by_year(spark, sf_dir):
    """A register whose files have other columns every year, written from customers, as one."""
    name = F.concat("c_mktsegment", F.lit(", "), (F.col("c_custkey") % 1000).cast("string"))
    c = table(spark, sf_dir, "customer").select(F.concat(name, F.lit(" ")).alias("name"), (F.col("c_custkey") % 4).alias("k"))
    files = {}
    for year, columns in YEARS.items():
        files[year] = scratch_path(spark, f"register-{year}")
        listed = c.filter(F.col("k").isin({2021: [0, 2], 2022: [1, 3], 2023: [1, 2]}[year]))
        listed.select(*[(F.col("name") if "employer" in column.lower() else F.lit("other")).alias(column) for column in columns]).write.csv(files[year], header=True)
    return register_of_years(spark, files, ["employer", "employer name"], least=1)


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages WHERE page_id % 6 <> 5)
    SELECT page_id, trim(regexp_replace(t, '[^a-zA-Z0-9 ]', ' ', 'g')) AS title, host AS company, CASE WHEN page_id % 6 IN (1, 3) THEN 'Bonn' ELSE 'Lund' END AS location, CASE WHEN page_id % 6 IN (1, 3) THEN 'DE' ELSE 'Sweden' END AS country,
      '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS posted_raw, 'a & b ' || page_id AS description, CASE WHEN page_id % 6 IN (1, 3) THEN 'Part-time' ELSE 'Full-time' END AS employment_type, CASE WHEN page_id % 2 = 0 THEN 'Remote' ELSE '' END AS workplace_type FROM p WHERE trim(regexp_replace(t, '[^a-zA-Z0-9 ]', ' ', 'g')) <> '' AND host <> ''"""
)
def structured_data(spark, sf_dir):
    """The postings that pages carry as JSON-LD: alone, in a list, in a graph, in a list of items, behind a broken block."""
    k = F.col("page_id")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^a-zA-Z0-9 ]", " "))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    german = (k % 6).isin(1, 3)
    place = F.when(german, '[{"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}]').otherwise('{"address": {"addressLocality": "Lund", "addressCountry": {"@type": "Country", "name": "Sweden"}}}')
    kind = F.when(german, '["PART_TIME", "OTHER"]').otherwise('"FULL_TIME"')
    remote = F.when(k % 2 == 0, ', "jobLocationType": "TELECOMMUTE"').otherwise("")
    text = F.format_string('{"@type": %s, "title": "%s", "hiringOrganization": {"@type": "Organization", "name": "%s"}, "jobLocation": %s, "datePosted": "2024-01-%02d", "description": "&lt;p&gt;a &amp;amp; b&lt;/p&gt; %d", "employmentType": %s%s}', F.when(german, '["Thing", "JobPosting"]').otherwise('"JobPosting"'), title, host, place, k % 28 + 1, k, kind, remote)
    shapes = [text, F.concat(F.lit('[{"@type": "WebSite"}, '), text, F.lit("]")), F.concat(F.lit('{"@graph": [{"@type": "Organization", "title": "no"}, '), text, F.lit("]}")), F.concat(F.lit('{"@type": "ItemList", "itemListElement": [{"item": '), text, F.lit("}]}")), F.concat(F.lit('{"broken": </script><script id="x" type="application/ld+json">'), text), F.lit('{"@type": "Article", "title": "no posting"}')]
    block = F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").filter((title != "") & (host != "")).select("page_id", F.concat("html", F.lit('<script type="application/ld+json">'), block, F.lit("</script>")).alias("html"))
    return structured_postings(pages).drop("until_raw", "url")
