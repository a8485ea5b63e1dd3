"""Column functions that clean and normalise postings' fields."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Legal forms that are no part of a company's name.
LEGAL_FORMS = "ab ag as aps bv co corp corporation gmbh inc kg limited llc llp ltd nv oy plc pty sa sarl sas se spa srl".split()
#: Words of a company's name that say where or what kind of company it is.
COMPANY_NOISE = "group holding holdings international global company europe germany france spain uk".split()


def text_of(c: Column) -> Column:
    """Null as the empty string, otherwise trimmed."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def squeezed(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s]+", " "))


def strip_html(c: Column) -> Column:
    """The text between tags, with single spaces; references are left alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^<]+?>", " "), r"\s+", " "))


@pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded once."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def company_norm(c: Column) -> Column:
    """Lower case, dots and slashes dropped, other punctuation as spaces, legal forms dropped as whole words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[./]", ""), r"[^\p{L}\p{N}]+", " ")
    words = F.split(F.trim(plain), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS) & (w != "")), " ")


def company_key(c: Column) -> Column:
    """An ASCII key without legal forms and noise words; keys of under three characters are empty."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    key = F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS, *COMPANY_NOISE) & (w != "")), "")
    return F.when(F.length(key) >= 3, key).otherwise("")


def title_head(c: Column) -> Column:
    """What stands before the first separator of a board's tail; heads of under four characters are empty."""
    head = F.trim(F.split(squeezed(c), r" [|–-] ")[0])
    return F.when(F.length(head) >= 4, head).otherwise("")


def dedup_title_key(title: Column, company: Column | None = None) -> Column:
    """Lower case; the employer with its connector, a short tail after the last bar, gender tags, brackets and what is no
    Latin letter are dropped."""
    from siftmill.functions.titles import without_employer

    t = F.lower(F.coalesce(title, F.lit(""))) if company is None else without_employer(title, company)
    t = F.regexp_replace(t, r"\|(?:\s*[^\s|]+){1,3}\s*$", " ")
    t = F.regexp_replace(t, r"\(?\b[mfwd]\s*/\s*[mfwd](?:\s*/\s*[mfwdx])?\b\)?", " ")
    t = F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"[€$£]?\s*\d[\d.,]*\s*(?:k|eur|usd|gbp)?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-zÀ-ɏ ]+", " "), " +", " "))


def url_host(url: Column) -> Column:
    """The lower-case host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def url_without_fragment(url: Column) -> Column:
    """Fragment and closing slash dropped, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), "/+$", ""))


def url_page(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", "")


def url_identity(url: Column) -> Column:
    """Without query, fragment, closing slash and a segment that names a language."""
    plain = F.regexp_replace(F.lower(url_page(url)), "/+$", "")
    return F.regexp_replace(plain, "(://[^/]+)/(?:en|de|fr|es|it|nl)(/|$)", "$1$2")


def url_exact(url: Column) -> Column:
    return F.lower(F.trim(F.coalesce(url, F.lit(""))))


def site_tail_removed(title: Column, site: Column) -> Column:
    """A title without its site's name as head or as one of the last two segments; never under three characters."""
    name = F.lower(site)
    parts = F.split(F.coalesce(title, F.lit("")), r" [|–-] ")
    n = F.size(parts)
    is_site = lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]+", "") == F.regexp_replace(name, "[^a-z0-9]+", "")
    kept = F.filter(parts, lambda p, i: ~(is_site(p) & ((i == 0) | (i >= n - 2))))
    out = F.array_join(kept, " - ")
    return F.when((F.length(out) >= 3) & (n > 1), out).otherwise(F.coalesce(title, F.lit("")))


def mirrored_address(url: Column) -> Column:
    """The address behind a mark-down copy of a page."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"\.md($|[?#])", "$1")


def glob_pattern(glob: str) -> str:
    """An anchored pattern: ``*`` stays inside a segment, ``**`` crosses segments, all else is literal."""
    import re

    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", glob)) + "$"


#: A note stands at the end, apart from the text, and has no dollar signs of its own.
NOTE = r"(?:^|\s)\s*\$\$([^$]*)\$\$\s*$"


def drop_note_removed(text: Column) -> Column:
    """A text without the removal notes that older rows carry between double dollar signs."""
    return F.rtrim(F.regexp_replace(F.coalesce(text, F.lit("")), NOTE, ""))


def drop_note_added(text: Column, reason: Column) -> Column:
    """The text with one note of why it was removed, in place of any that it had; without a reason none."""
    plain = drop_note_removed(text)
    return F.when(F.trim(F.coalesce(reason, F.lit(""))) == "", plain).otherwise(F.concat(plain, F.lit("\n$$ "), F.trim(reason), F.lit(" $$")))


def drop_note_of(text: Column) -> Column:
    """The note at the end of a text, empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), NOTE, 1))


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
