"""From a page of a list to a glob for its postings: links grouped by their place, a trie over the addresses of a group,
and the addresses of the site as judge."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.text import url_host
from siftmill.operators.crawl import absolute

#: Fixed value: elements of HTML that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where one of their kind begins, and what holds them apart.
ENDED_BY = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ("div", "section", "article", "li", "td")}
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def places(html: str) -> Iterator[tuple[str, str]]:
    """The links of a page in order, each with its place: the elements around it, outermost first, with their classes but
    without digits, so that numbered cards are one place. End tags without a start are skipped, starts without an end are
    closed by what ends around them."""
    stack: list[tuple[str, str]] = []
    for tag in _TAG.finditer(html):
        end, name, rest = tag[2], tag[3], tag[4]
        if name is None:
            continue
        name = name.lower()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in ENDED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                if k >= len(stack) or stack[k][0] in ENDED_BY[name]:
                    break
        known = {m[1].lower(): m[2].strip("\"'") for m in _ATTRIBUTE.finditer(rest)}
        own = name + "".join("." + re.sub(r"[0-9]+", "0", c.lower()) for c in sorted(set(known.get("class", "").split())))
        if name == "a" and known.get("href"):
            yield known["href"].replace("&amp;", "&"), ">".join([*(s for _, s in stack), own])
        if name not in VOID and not rest.rstrip().endswith("/"):
            stack.append((name, own))


def placed_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """keys, pos, href (resolved) and place, the hash of the link's place, of every link; null pages have none."""
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_url string, pos int, raw string, place string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, raw, place = [], [], [], []
            for k, text in enumerate(batch.column("_html")):
                for n, (href, where) in enumerate(places(text.as_py() or "")):
                    rows.append(k)
                    at.append(n)
                    raw.append(href)
                    place.append(where)
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (*keys, "_url")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(raw, pa.string()), pa.array(place, pa.string())], names=[*keys, "_url", "pos", "raw", "place"])

    found = pages.select(*keys, F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(run, schema)
    return found.select(*keys, "pos", absolute(F.col("_url"), F.col("raw")).alias("href"), F.xxhash64("place").alias("place")).filter("href IS NOT NULL")


def card_groups(links: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, place, href: the distinct addresses of places that hold at least ``least`` of them."""
    cards = links.select(*keys, "place", "href").distinct()
    large = cards.groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return cards.join(large, [*keys, "place"]).drop("_n")


def segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/"), lambda s: s != "")


def globs_of(cards: DataFrame, keys: list[str], share: int = 90, most: int = 8) -> DataFrame:
    """The globs of each group of addresses: keys, glob, cards; of each value of ``keys`` the first ``most``, by cards.

    Of a group the addresses of the usual depth count. A trie is walked down from its root: where one child has ``share``
    percent of what hangs there its name is kept, and else the place is open; an open last place is the posting's own.
    A group whose addresses all end alike is no group of postings and has no glob.
    """
    group = [*keys, "place"]
    parted = cards.select(*group, segments(F.col("href")).alias("s")).filter("size(s) > 0")
    depth = parted.groupBy(*group, F.size("s").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.max_by("d", F.struct("n", "d")).alias("d"), F.max("n").alias("cards"))
    usual = parted.join(depth, group).filter("size(s) = d")
    # nodes of the trie, level by level: what a name has of all that hang at its level
    levels = usual.select(*group, "d", "cards", F.posexplode("s").alias("level", "name")).groupBy(*group, "d", "cards", "level", "name").agg(F.count(F.lit(1)).alias("n"))
    main = levels.groupBy(*group, "d", "cards", "level").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.max("n").alias("n"))
    part = F.when(F.col("n") * 100 >= F.col("cards") * share, F.col("name")).otherwise(F.lit("*"))
    glob = main.groupBy(*group, "d", "cards").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", part.alias("p")))), lambda x: x["p"]), "/").alias("tail"))
    named = glob.filter(F.col("tail").endswith("*")).groupBy(*keys, F.concat(F.lit("**/"), "tail").alias("glob")).agg(F.sum("cards").alias("cards"))
    order = Window.partitionBy(*keys).orderBy(F.desc("cards"), "glob")
    return named.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at")


def judged(globs: DataFrame, urls: DataFrame, site: str, most_others: int = 2, least: int = 2) -> DataFrame:
    """``globs`` (site, glob, ...) with the addresses of their site that they match, how many of these are no postings, and
    whether they may be used. ``urls`` has the site, url and candidate; a site has few globs, its addresses meet each."""
    literal = F.regexp_replace("glob", r"([.+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.replace(literal, F.lit("**"), F.lit("\x00")), F.lit("*"), F.lit("[^/]*")), F.lit("\x00"), F.lit(".*")), F.lit("$"))
    bare = F.regexp_replace("url", "[?#].*$", "")
    met = urls.select(site, bare.alias("url"), "candidate").join(globs.select(site, "glob", pattern.alias("pattern")), site).filter(F.expr("url RLIKE pattern"))
    counts = met.groupBy(site, "glob").agg(F.count(F.lit(1)).alias("matched"), F.count_if(~F.col("candidate")).alias("others"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = globs.join(counts, [site, "glob"], "left").select(*globs.columns, zero("matched"), zero("others"))
    return out.withColumn("usable", (F.col("others") <= most_others) & (F.col("matched") - F.col("others") >= least))


def discovered(pages: DataFrame, urls: DataFrame, site: str, least: int = 3, **limits: int) -> DataFrame:
    """The whole chain for each site: from the links of its list pages (site, url, html) to globs judged by its addresses."""
    links = placed_links(pages, [site])
    host = url_host(F.col("href"))
    links = links.filter(host != "")
    return judged(globs_of(card_groups(links, [site], least), [site], **limits), urls, site)
