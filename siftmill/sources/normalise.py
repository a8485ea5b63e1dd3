"""Raw items of many sources as rows of one schema.

A source is described by the paths of its fields. Raw items are JSON text; the first path that holds a value that is
neither null nor empty counts. Items that cannot be parsed become rows of nulls with the raw text in ``problem``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import first_present, strip_html

COLUMNS = ("title", "company", "location", "country", "posted_raw", "url", "description", "employment_type", "workplace_type")
#: Spellings of work places and kinds of employment.
WORKPLACES = {"remote": "Remote", "fully remote": "Remote", "telecommute": "Remote", "hybrid": "Hybrid", "on-site": "On-site", "onsite": "On-site", "in person": "On-site"}
EMPLOYMENT = {"full-time": "Full-time", "full time": "Full-time", "part-time": "Part-time", "part time": "Part-time", "contract": "Contract", "temporary": "Temporary", "internship": "Internship", "volunteer": "Volunteer"}


@dataclass(frozen=True)
class Source:
    """Where a source keeps its items and their fields; thin sources carry no full text."""

    name: str
    items: str
    paths: dict[str, tuple[str, ...]]
    thin: bool = False
    needs: str | None = None
    fixed: dict[str, str] = field(default_factory=dict)


def _paths(**named: str) -> dict[str, tuple[str, ...]]:
    return {k: tuple(v.split()) for k, v in named.items()}


#: The fields of the sources' public payloads.
SOURCES = {
    s.name: s
    for s in (
        Source("se_board", "$.hits[*]", _paths(title="$.headline", company="$.employer.name", location="$.workplace_address.municipality", posted_raw="$.publication_date", url="$.webpage_url", description="$.description.text"), fixed={"country": "Sweden"}),
        Source("de_board", "$.ergebnisliste[*]", _paths(title="$.stellenangebotsTitel", company="$.firma", location="$.stellenlokationen[0].adresse.ort", posted_raw="$.datumErsteVeroeffentlichung", url="$.referenznummer"), thin=True, needs="$.referenznummer", fixed={"country": "Germany"}),
        Source("aggregator", "$.jobs[*]", _paths(title="$.title", company="$.company", location="$.location", posted_raw="$.updated", url="$.link", description="$.snippet"), thin=True),
        Source("uk_board", "$.results[*]", _paths(title="$.jobTitle", company="$.employerName", location="$.locationName", posted_raw="$.date", url="$.jobUrl $.jobId", description="$.jobDescription"), fixed={"country": "United Kingdom"}),
        Source("remote_board", "$.jobs[*]", _paths(title="$.title $.position", company="$.company_name $.company", location="$.candidate_required_location $.location", posted_raw="$.publication_date $.date", url="$.url", description="$.description"), fixed={"workplace_type": "remote"}),
        Source("fr_board", "$.resultats[*]", _paths(title="$.intitule", company="$.entreprise.nom", location="$.lieuTravail.libelle", posted_raw="$.dateCreation", url="$.origineOffre.urlOrigine $.id", description="$.description $.intitule"), needs="$.id", fixed={"country": "France"}),
        Source("eu_board", "$.jvs[*]", _paths(title="$.title", company="$.employer.name", posted_raw="$.creationDate", url="$.id", description="$.description $.title"), needs="$.id"),
        Source("remote_list", "$[*]", _paths(title="$.position", company="$.company", location="$.location", country="$.location", posted_raw="$.date", url="$.url", description="$.description $.position"), needs="$.id"),
        Source("dev_board", "$[*]", _paths(title="$.name", company="$.company", location="$.actualCity $.cityCategory", posted_raw="$.activeFrom", url="$.jobUrl", description="$.name"), thin=True, needs="$.jobUrl", fixed={"country": "Switzerland"}),
        Source("ch_board", "$.documents[*]", _paths(title="$.title", company="$.company.name", location="$.place", posted_raw="$.publicationDate", url="$.id"), thin=True, fixed={"country": "Switzerland"}),
        Source("network", "$[*]", _paths(title="$.title $.job_title", company="$.companyName $.company.name", location="$.location", posted_raw="$.postedAt $.posted_date", url="$.link $.url", description="$.descriptionText $.descriptionHtml", employment_type="$.employmentType $.job_insights", workplace_type="$.workplaceType $.workRemoteAllowed")),
        Source("portal", "$[*]", _paths(title="$.positionName $.title", company="$.company", location="$.location.formatted $.location.city $.location", country="$.location.country $.country", posted_raw="$.postingDateParsed $.postedAt", url="$.url", description="$.description $.descriptionHTML", employment_type="$.jobType")),
        Source("web_search", "$.organicResults[*]", _paths(title="$.title", url="$.url", description="$.websiteContent.text $.description")),
    )
}


def spelled(value: Column, spellings: dict[str, str]) -> Column:
    """The value of the closed domain that the spelling stands for; the first that a longer text holds; else empty."""
    v = F.lower(F.coalesce(value, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for k, word in spellings.items():
        out = out.when(v.contains(k), word)
    return out.otherwise("")


def normalised(raw: DataFrame, source: Source, item: str = "item") -> DataFrame:
    """``raw`` has a JSON text for each payload; returns one row per item of it with COLUMNS, platform, thin and problem."""
    parsed = raw.select(F.col(item).alias("_raw"), F.try_parse_json(item).alias("_v"))
    parts = source.items.removesuffix("[*]")
    many = F.try_variant_get("_v", parts, "array<variant>") if source.items.endswith("[*]") else F.array(F.col("_v"))
    rows = parsed.select("_raw", F.explode_outer(F.when(F.col("_v").isNotNull(), many)).alias("_i"), F.col("_v").isNull().alias("_bad"))

    def value(column: str) -> Column:
        if column in source.fixed:
            return F.lit(source.fixed[column])
        texts = [F.try_variant_get("_i", p, "string") for p in source.paths.get(column, ())]
        found = [F.when(~t.rlike(r"(?s)^\{.*\}$"), t) for t in texts]  # an object is no text
        return first_present(*found) if found else F.lit(None).cast("string")

    out = rows.select("*", *[value(c).alias(c) for c in COLUMNS])
    if source.needs:
        out = out.filter(F.col("_bad") | F.try_variant_get("_i", source.needs, "string").isNotNull())
    out = out.filter(F.col("_bad") | F.col("_i").isNotNull())
    return out.select(
        *[c for c in COLUMNS if c not in ("description", "employment_type", "workplace_type")],
        F.when(F.col("description").isNotNull(), strip_html(F.col("description"))).alias("description"),
        spelled(F.col("employment_type"), EMPLOYMENT).alias("employment_type"),
        spelled(F.col("workplace_type"), WORKPLACES).alias("workplace_type"),
        F.lit(source.name).alias("platform"),
        F.lit(source.thin).alias("thin"),
        F.when(F.col("_bad"), F.col("_raw")).alias("problem"),
    )


def collected(parts: list[DataFrame], url: str = "url") -> DataFrame:
    """All sources' rows together, the first of each address; rows without one are told apart by title and company."""
    from siftmill.operators.survivorship import first_wins

    together = None
    for k, part in enumerate(parts):
        part = part.withColumn("_source_no", F.lit(k))
        together = part if together is None else together.unionByName(part, allowMissingColumns=True)
    key = F.coalesce(F.nullif(F.col(url), F.lit("")), F.concat_ws("\x1f", "title", "company"))
    return first_wins(together, key, [F.col("_source_no"), F.col("title"), F.col("description")], keep_blank=False).drop("_source_no")
