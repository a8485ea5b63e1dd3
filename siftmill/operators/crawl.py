"""Following links from page to page and from site map to site map, round by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.tables import stored

#: Fixed value: maps whose address speaks of jobs are read first.
JOB_MAP = r"(?i)job|career|vacanc|stellen|position|emploi"


def reached(links: DataFrame, seeds: DataFrame, most_depth: int, most_nodes: int | None = None) -> DataFrame:
    """What can be reached over ``links`` (source, target) from ``seeds`` (node): node and depth, the least number of steps.

    A round joins the nodes that are new with their links and leaves out what was seen before, so that circles end and a
    node is followed once. Rounds end when nothing is new, after ``most_depth`` steps, or once ``most_nodes`` were seen;
    the round that passes that number is kept up to it, by the order of the nodes. Null ends lead nowhere.
    """
    edges = stored(links.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct(), "links")
    new = stored(seeds.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "frontier")
    rounds, n = [new], new.count()
    for depth in range(1, most_depth + 1):
        if most_nodes is not None and n >= most_nodes:
            break
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        ahead = edges.join(new.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        new = stored(ahead.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        found = new.count()
        if not found:
            break
        rounds.append(new)
        n += found
    if most_nodes is not None and n > most_nodes:
        rounds[-1] = rounds[-1].orderBy("node").limit(most_nodes - (n - rounds[-1].count()))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def absolute(base: Column, address: Column) -> Column:
    """An address as a browser would resolve it at ``base``: schemes stay, // takes the scheme, / the host, others the folder.
    Fragments are cut, and addresses that are no pages (mail, script, data) are null."""
    a = F.regexp_replace(F.trim(F.coalesce(address, F.lit(""))), "#.*$", "")
    root, folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return (
        F.when(a == "", None)
        .when(a.rlike("^[hH][tT][tT][pP][sS]?://"), a)
        .when(a.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(a.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), a))
        .when(a.startswith("/"), F.concat(root, a))
        .when(a.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), a))
        .otherwise(F.concat(folder, F.lit("/"), F.regexp_replace(a, r"^(?:\./)+", "")))
    )


def anchors(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The links of each page: its columns but ``html``, pos and href, resolved, in page order.

    href may stand in double quotes, single quotes or none, with blanks around the sign and other attributes before it."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(tags).alias("pos", "_raw"))
    bare = F.regexp_replace(F.regexp_replace(F.col("_raw"), "^[\"']|[\"']$", ""), "&amp;", "&")
    return rows.withColumn("href", absolute(F.col(url), bare)).drop("_raw").filter("href IS NOT NULL")


def same_domain(url: Column, other: Column) -> Column:
    """Both addresses are of one registered domain: the last two labels of their hosts, in lower case."""
    domain = lambda u: F.regexp_extract(F.lower(u), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)(?:[:/?#]|$)", 1)
    return (domain(url) == domain(other)) & (domain(url) != "")


def site_map_pages(documents: DataFrame, seeds: DataFrame, most_maps: int = 6, most_depth: int = 4, limit: int = 500) -> DataFrame:
    """The pages that site maps name, from the maps of ``seeds`` (site, map) on: site, page.

    ``documents`` (url, body) are the maps that could be read; one of very many addresses may come in parts, as several
    rows of its url. An index names further maps, whatever their addresses
    end with; another map names pages, and maps where an address ends with .xml. Of each map at most ``most_maps`` further
    ones are followed, those that speak of jobs first, then in the map's order; of a site at most ``limit`` pages stay, by
    depth and then by address. A map is read once for a site, so that maps that name each other end.
    """
    body = F.coalesce("body", F.lit(""))
    # what kind of map it is, is told before its addresses become rows: each of them would read the whole map again
    read_ = documents.filter("url IS NOT NULL").select("url", body.alias("body"), body.rlike(r"(?i)<sitemapindex[\s>]").alias("index"))
    entries = read_.select("url", "index", F.posexplode(F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))).alias("pos", "loc"))
    entries = stored(entries.withColumn("is_map", F.col("index") | F.col("loc").endswith(".xml")), "entries")
    order = Window.partitionBy("url").orderBy((~F.col("loc").rlike(JOB_MAP)).cast("int"), "pos", "loc")
    maps = entries.filter("is_map").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most_maps)
    # a site's own copy of the graph is never made: rounds carry (site, map)
    new = stored(seeds.select("site", F.col("map").alias("url")).distinct().withColumn("depth", F.lit(0)), "maps")
    rounds = [new]
    for depth in range(1, most_depth + 1):
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        ahead = new.join(maps.select("url", "loc"), "url").select("site", F.col("loc").alias("url")).distinct()
        new = stored(ahead.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(depth)), "maps")
        if new.isEmpty():
            break
        rounds.append(new)
    read = rounds[0]
    for r in rounds[1:]:
        read = read.unionByName(r)
    pages = read.join(entries.filter("NOT is_map"), "url").groupBy("site", F.col("loc").alias("page")).agg(F.min("depth").alias("depth"))
    return pages.withColumn("at", F.row_number().over(Window.partitionBy("site").orderBy("depth", "page"))).filter(F.col("at") <= limit).select("site", "page")
