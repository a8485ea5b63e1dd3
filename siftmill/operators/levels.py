"""Whether a posting is for another level than the one that is looked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.vocabulary import pattern_of, terms_of

#: Years that are too many or too few for a level.
TOO_MANY = {"junior": 3, "entry": 2, "mid": 6, "senior": None}
TOO_FEW = {"junior": None, "entry": None, "mid": 1, "senior": 3}
#: Words of a platform's field and of titles that name another level.
WRONG_FIELDS = {"junior": ("mid-senior level", "director", "executive"), "entry": ("mid-senior level", "director", "executive"), "mid": ("internship", "entry level", "director", "executive"), "senior": ("internship", "entry level", "associate")}
WRONG_TITLES = {"junior": "senior", "entry": "senior", "mid": "internship", "senior": "internship"}
#: Our own patterns: what makes a number of years a requirement, what says that it is none, and what makes a range one
#: of ages.
ASKS = "experience|required|requirement|must have|at least|minimum|erfahrung"
WAIVES = r"(?:no|zero|without(?: any)?) (?:[a-z]+ )?experience|(?:not|never) (?:strictly |absolutely )?(?:required|needed|necessary|mandatory)|(?:is|are|would be) (?:a plus|an advantage|nice to have|optional)|we(?: will|'ll)? (?:train|teach)|training (?:is |will be )?provided|you(?: will|'ll) (?:learn|gain)"
AGES = "years? old|aged|age of|ages"


def years_from(n: int) -> str:
    """Numbers of one or two digits of at least n (below ten), as a pattern."""
    return rf"(?:[{n}-9]|[1-9]\d)"


def years_to(n: int) -> str:
    """Numbers of at most n (below ten), as a pattern."""
    return f"[0-{n}]"


def year_patterns(level: str) -> list[tuple[str, bool]]:
    """Patterns of one sentence that speak of too many or too few years, and whether the sentence must ask for them."""
    out = []
    if (n := TOO_MANY[level]) is not None:
        out += [(rf"(?:^|\D){years_from(n)}\s*\+\s*years?", False), (rf"(?:^|\D){years_from(n)}\s*(?:-|–|to)\s*\d{{1,2}}\s*years?", False), (rf"(?:^|\D){years_from(n)}\s+years?", True)]
    if (n := TOO_FEW[level]) is not None:
        out += [(rf"(?:^|\D){years_to(n)}\s*(?:-|–|to)\s*{years_to(n)}\s*years?", True), (rf"(?:^|[^\d–-]){years_to(n)}\s+years?", True)]
    return out


def wrong_level(title: Column, body: Column, field: Column, level: str) -> Column:
    """By the platform's field, then the title's words, then years asked for in some sentence that does not speak of ages
    and, where a bare number must be a requirement, does not waive it."""
    low = F.lower(F.concat_ws(" ", title, body))
    sentences = F.split(low, r"\.")

    def speaks(s: Column) -> Column:
        out = F.lit(False)
        for pattern, asks in year_patterns(level):
            hit = s.rlike(pattern)
            out = out | ((hit & s.rlike(ASKS) & ~s.rlike(WAIVES)) if asks else hit)
        return out & ~s.rlike(AGES)

    by_field = F.lower(F.coalesce(field, F.lit(""))).isin(*WRONG_FIELDS[level])
    by_title = F.lower(F.coalesce(title, F.lit(""))).rlike(pattern_of(terms_of(WRONG_TITLES[level])))
    return by_field | by_title | (low.contains("year") & F.exists(sentences, speaks))


def sql_wrong_level(title: str, body: str, field: str, level: str) -> str:
    """The same test as DuckDB SQL; title and body are not null."""
    tests = " OR ".join(f"regexp_matches(s, '{p}')" + (f" AND regexp_matches(s, '{ASKS}') AND NOT regexp_matches(s, '{WAIVES.replace(chr(39), chr(39) * 2)}')" if asks else "") for p, asks in year_patterns(level))
    low = f"lower({title} || ' ' || {body})"
    fields = ", ".join(f"'{x}'" for x in WRONG_FIELDS[level])
    by_title = f"regexp_matches(lower({title}), '{pattern_of(terms_of(WRONG_TITLES[level]))}')"
    return f"(lower(coalesce({field}, '')) IN ({fields}) OR {by_title} OR (contains({low}, 'year') AND len(list_filter(string_split({low}, '.'), lambda s: ({tests}) AND NOT regexp_matches(s, '{AGES}'))) > 0))"
