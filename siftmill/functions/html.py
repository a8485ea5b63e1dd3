"""Text and structured postings out of pages."""

from __future__ import annotations

import json
import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements that hold no readable text, and structured data's element.
SKIPPED = frozenset("script style nav footer header noscript form aside template svg".split())
STRUCTURED = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


#: Fixed values of HTML: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    """Readable text. An element that is skipped ends with itself or with any element that stands around it, so that one
    that is never closed takes no more than its surroundings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.counts, self.skipping, self.parts = [], Counter(), 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
            self.counts[tag] += 1
            self.skipping += tag in SKIPPED

    def handle_endtag(self, tag):
        while self.counts[tag]:
            last = self.open.pop()
            self.counts[last] -= 1
            self.skipping -= last in SKIPPED
            if last == tag:
                break

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)


def plain_text(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def posting_of(page: str) -> dict | None:
    """The first object of a JobPosting in the page's structured data, looking into lists and objects."""
    for block in STRUCTURED.findall(page or ""):
        try:
            queue = [json.loads(block)]
        except ValueError:
            continue
        while queue:
            node = queue.pop(0)
            if isinstance(node, dict):
                kind = node.get("@type")
                if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
                    return node
                queue += node.values()
            elif isinstance(node, list):
                queue += node
    return None


def readable(page: str | None) -> str:
    """The structured description if it is long and a good part of the page, else the page's plain text."""
    if not page:
        return ""
    plain = plain_text(page)
    posting = posting_of(page) if "ld+json" in page else None
    told = " ".join(re.sub(r"<[^<]+?>", " ", unescape(str((posting or {}).get("description") or ""))).split())
    return told if len(told) >= 200 and (len(plain) < 300 or 2 * len(told) >= len(plain)) else plain


@pandas_udf(StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(readable)


@pandas_udf(StringType())
def json_ld_posting(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: json.dumps(x, sort_keys=True, ensure_ascii=False) if p and "ld+json" in p and (x := posting_of(p)) else None)
