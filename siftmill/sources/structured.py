"""Postings that pages carry as structured data (JSON-LD), as rows of the sources' schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import first_present, strip_html, unescaped
from siftmill.sources.normalise import EMPLOYMENT, WORKPLACES, spelled

BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
#: Where a JobPosting keeps its fields.
PATHS = {
    "title": ("$.title", "$.name"),
    "company": ("$.hiringOrganization.name", "$.hiringOrganization[0].name", "$.hiringOrganization"),
    "location": ("$.jobLocation.address.addressLocality", "$.jobLocation[0].address.addressLocality", "$.jobLocation.address.addressRegion", "$.jobLocation.address", "$.jobLocation"),
    "country": ("$.jobLocation.address.addressCountry.name", "$.jobLocation[0].address.addressCountry.name", "$.jobLocation.address.addressCountry", "$.jobLocation[0].address.addressCountry"),
    "posted_raw": ("$.datePosted",),
    "until_raw": ("$.validThrough",),
    "url": ("$.url", '$["@id"]'),
    "description": ("$.description",),
    "employment_type": ("$.employmentType[0]", "$.employmentType"),
    "workplace_type": ("$.jobLocationType",),
}


def nodes_within(value: Column, depth: int) -> Column:
    """The value and all that lies in it, level by level; on a level lists in their order, objects by their keys."""
    none = F.array().cast("array<variant>")
    below = lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.map_values(F.try_variant_get(n, "$", "map<string, variant>")), none)
    levels = [F.array(value)]
    for _ in range(depth):
        levels.append(F.flatten(F.transform(levels[-1], below)))
    return F.concat(*levels)


def is_a(node: Column, kind: str) -> Column:
    """Whether the node's type is ``kind``, alone or among others."""
    many = F.array_contains(F.try_variant_get(node, '$["@type"]', "array<string>"), kind)
    return F.coalesce(many, F.try_variant_get(node, '$["@type"]', "string") == kind, F.lit(False))


def structured_postings(pages: DataFrame, key: str = "page_id", html: str = "html", depth: int = 4) -> DataFrame:
    """The first JobPosting of each page: ``key`` and the fields of PATHS; pages without one are left out.

    Blocks are read in page order, those that are no JSON are skipped, and in a block the posting nearest to its root
    counts, at most ``depth`` lists and objects below it. An object where a text is expected is none. Descriptions lose
    their mark-up, also where it is escaped. Pages with the same key, or without one, are told apart.
    """
    rows = pages.select(F.col(key).alias("_key"), F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(BLOCK), F.lit(1)).alias("_blocks")).filter("size(_blocks) > 0")
    found = F.flatten(F.transform("_blocks", lambda b: F.filter(nodes_within(F.try_parse_json(b), depth), lambda n: is_a(n, "JobPosting"))))
    first = rows.select("_key", F.try_element_at(found, F.lit(1)).alias("_p")).filter("_p IS NOT NULL")

    def value(column: str) -> Column:
        texts = [F.try_variant_get("_p", p, "string") for p in PATHS[column]]
        return first_present(*[F.when(~t.rlike(r"(?s)^[\{\[].*[\}\]]$"), t) for t in texts])

    plain = {c: value(c) for c in PATHS}
    # mark-up that was escaped is mark-up again, whose text has references of its own
    plain["description"] = unescaped(strip_html(unescaped(plain["description"])))
    plain["employment_type"] = spelled(F.replace(plain["employment_type"], F.lit("_"), F.lit("-")), EMPLOYMENT)
    plain["workplace_type"] = spelled(plain["workplace_type"], WORKPLACES)
    return first.select(F.col("_key").alias(key), *[c.alias(name) for name, c in plain.items()])
