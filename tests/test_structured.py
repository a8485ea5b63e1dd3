"""Structured data of pages: shapes, what is broken, what is missing."""

import json

from siftmill.sources.structured import PATHS, structured_postings


def block(value) -> str:
    return f'<SCRIPT type="application/ld+json">\n{value if isinstance(value, str) else json.dumps(value)}\n</SCRIPT>'


def posting(title="T", **more):
    return {"@type": "JobPosting", "title": title, **more}


def test_structured_postings(spark):
    whole = posting(
        "Dev", hiringOrganization={"name": "Acme"}, jobLocation=[{"address": {"addressLocality": "Bonn", "addressCountry": {"name": "Germany"}}}],
        datePosted="2024-01-02", validThrough="2024-03-01", url="http://a/1", description="&lt;b&gt;x&lt;/b&gt; <i>y</i> &amp;amp; z", employmentType=["FULL_TIME"], jobLocationType="TELECOMMUTE",
    )
    cases = {
        1: block(whole),
        2: block([[{"@graph": [posting("deep")]}, {"@type": ["Thing", "JobPosting"], "title": "near"}]]),
        3: block("{broken") + block({"@type": "Article"}) + block(posting("third", hiringOrganization="Name only", jobLocation="Lund")) + block(posting("fourth")),
        4: block({"@type": "Article", "title": "no"}),
        5: "",
        6: None,
        7: block({"a": {"b": {"c": {"d": {"e": posting("too deep")}}}}}),
        8: block({"@type": "JobPosting"}),
        9: block("null") + block("3") + block('"JobPosting"') + block(posting("x" * 300_000)),
        10: "<script>" + json.dumps(posting()) + "</script>",
    }
    rows = [*cases.items(), (1, block(posting("twice"))), (None, block(posting("no key")))]
    got = sorted(structured_postings(spark.createDataFrame(rows, "page_id int, html string")).collect(), key=lambda r: (r["page_id"] or 0, r["title"] or ""))
    assert [(r["page_id"], (r["title"] or "")[:10]) for r in got] == [(None, "no key"), (1, "Dev"), (1, "twice"), (2, "near"), (3, "third"), (8, ""), (9, "x" * 10)]
    assert tuple(got[1]) == (1, "Dev", "Acme", "Bonn", "Germany", "2024-01-02", "2024-03-01", "http://a/1", "x y & z", "Full-time", "Remote")
    assert (got[4]["company"], got[4]["location"], got[4]["country"]) == ("Name only", "Lund", None) and len(got[6]["title"]) == 300_000
    assert structured_postings(spark.createDataFrame([], "page_id int, html string")).columns == ["page_id", *PATHS]
