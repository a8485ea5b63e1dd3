"""What addresses and links have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.text import glob_pattern


def url_prefixes(urls: DataFrame) -> DataFrame:
    """Prefixes of one and two path segments, with the addresses below them and the depth that most of these have."""
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    seg = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    rows = urls.select(seg.alias("seg")).filter("seg[0] <> ''")
    each = rows.select("seg", F.explode(F.sequence(F.lit(1), F.least(F.size("seg"), F.lit(2)))).alias("depth"))
    by_depth = each.groupBy(F.array_join(F.slice("seg", 1, F.col("depth")), "/").alias("prefix"), "depth", F.size("seg").alias("segments")).agg(F.count(F.lit(1)).alias("n"))
    return by_depth.groupBy("prefix", "depth").agg(F.sum("n").alias("support"), F.max_by("segments", F.struct("n", "segments")).alias("usual_depth"))


def proposed_globs(urls: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """At most so many globs for a site's postings, the best supported prefixes first."""
    found = url_prefixes(urls).filter(F.col("support") >= F.greatest(F.lit(least), F.col("depth") + 1))
    deeper = F.col("usual_depth") - F.col("depth")
    glob = F.concat(F.lit("**/"), F.col("prefix"), F.repeat(F.lit("/*"), F.greatest(deeper, F.lit(1))))
    return found.select(glob.alias("glob"), "support", "depth").orderBy("depth", F.desc("support"), "glob").limit(most)


def links_of(pages: DataFrame) -> DataFrame:
    """page_id, href and the link's place, in page order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "href"))


def link_shapes(pages: DataFrame, least: int = 3) -> DataFrame:
    """Links of a page by the shape of their path: digits as 0, other characters as a; groups of at least so many."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("href", "[?#].*$", ""), r"\d+", "0"), "[^/0]+", "a")
    return links_of(pages).select("page_id", shape.alias("shape"), "href").distinct().groupBy("page_id", "shape").agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") >= least)


def first_links(pages: DataFrame, most: int) -> DataFrame:
    """The first distinct links of each page."""
    first = links_of(pages).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("rn") <= most).drop("rn")


def glob_cover(urls: DataFrame, globs: list[str], candidate: Column, most_others: int = 2, least: int = 2) -> DataFrame:
    """For each of a few globs: the addresses that match it, how many of them are no candidates, and whether it may be used:
    it must cover at least so many candidates and hardly any other address."""
    known = F.array(*[F.struct(F.lit(g).alias("glob"), F.lit(glob_pattern(g)).alias("pattern")) for g in globs])
    rows = urls.select("url", candidate.alias("candidate"), F.explode(known).alias("g")).filter(F.expr("url RLIKE g.pattern"))
    counts = rows.groupBy(F.col("g.glob").alias("glob")).agg(F.count(F.lit(1)).alias("matched"), F.count_if(~F.col("candidate")).alias("others"))
    return counts.withColumn("usable", (F.col("others") <= most_others) & (F.col("matched") - F.col("others") >= least))
