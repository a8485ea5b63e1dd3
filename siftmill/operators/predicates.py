"""Predicates of one posting or page. Missing values keep a row unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.dates import let
from siftmill.functions.text import alnum_only, glob_pattern, squeezed, url_host, url_page
from siftmill.functions.vocabulary import MARKERS, TERMS, hit, hit_by_language, pattern_of, terms_of

#: Patterns of addresses and titles.
JOB_PATH = r"/(?:jobs?|careers?|vacanc(?:y|ies)|stellen|emplois?|empleos?|positions?)(?:/|$)"
EDITORIAL_PATH = r"/(?:blog|news|magazine|guides?|articles?|advice|press)(?:/|$)"
EDITORIAL_TITLE = r"^(?:how to|what is|why |top \d+|the best|guide to)"
ID_PARAMETER = r"[?&](?:id|jobid|job_id|ref|vacancy|jk)=[^&#]+"
LIST_END = r"/(?:jobs?|careers?|search|vacancies|stellen|emplois|empleos)/?$"
COUNTED_TITLE = r"(?:^|\s)\d[\d.,]*\+?\s+(?:jobs?|vacancies|positions|stellen|offres|ofertas)(?:\s|$)"
INDEX_PHRASE = r"(?:all|\d+) (?:open )?(?:jobs|vacancies|positions) (?:found|in|at|match)|search results for|sort by (?:date|relevance)|stellen gefunden|offres trouvées|ofertas encontradas"
BLOCKED = r"access denied|are you a robot|captcha|just a moment|page not found|forbidden|service unavailable"
TAG = r"\[[^\[\]\n]{1,40}\]"
#: Where a notice must stand, how many tags and phrases make an index, and when a text counts as English.
GONE_CHARS, INDEX_TAGS, INDEX_CHARS = 600, 8, 2_000
FEW_WORDS, MARKERS_OF_100 = 40, 8


def work_location(text: Column, tag: Column, thin: Column, mode: str = "remote") -> Column:
    """Whether a posting suits the mode: remote, not_remote or any.

    A platform's tag decides first. In remote mode a text that denies remote work, asks for the office or for days in it
    goes, a thin one stays, one that is silent goes, and so does one whose every mention of remote work is hedged;
    not_remote mode drops what is only remote and keeps the silent.
    """
    if mode == "any":
        return F.lit(True)
    remote, on_site, denied = hit(text, "remote"), hit(text, "on_site"), hit(text, "not_remote")
    label, thin = F.lower(F.coalesce(tag, F.lit(""))), F.coalesce(thin, F.lit(False))
    if mode == "not_remote":
        return F.when(label == "remote", False).when(label.isin("hybrid", "on-site"), True).when(denied | on_site | thin, True).otherwise(~remote)
    office = asks_office_days(text)
    out = F.when(label.isin("hybrid", "on-site"), False).when(label == "remote", ~denied & ~office)
    return out.when(~remote & on_site, False).when(denied | office, False).when(thin, True).when(~remote, False).otherwise(~only_hedged_remote(text))


def around_hits(text: Column, find: str, void: str, before: int, after: int, need_all: bool) -> Column:
    """A test over all hits of a pattern: a hit is void if another pattern is found in the characters around it.

    True if some hit is not void, or with ``need_all`` if there are hits and each of them is void.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("void"))

    def over(parts: Column) -> Column:
        hits, rest, whole = parts["hits"], parts["rest"], parts["text"]

        def step(s: Column, k: Column) -> Column:
            start = s["at"] + F.length(F.get(rest, k))
            end = start + F.length(F.get(hits, k))
            first = F.greatest(start - before, F.lit(0))
            near = F.substr(whole, first + 1, end - first + after)
            return F.struct(end.alias("at"), (s["n"] + 1).alias("n"), (s["void"] + near.rlike(void).cast("int")).alias("void"))

        walked = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step)
        return F.when(F.size(hits) == 0, False).otherwise(let(walked, lambda w: (w["n"] == w["void"]) if need_all else (w["n"] > w["void"])))

    # the text is computed once, and taken apart only where there is a hit
    parts = lambda t: F.struct(F.regexp_extract_all(t, F.lit(find), F.lit(0)).alias("hits"), F.split(t, find).alias("rest"), t.alias("text"))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(find), let(parts(t), over)).otherwise(False))


def sql_around_hits(text: str, find: str, void: str, before: int, after: int, need_all: bool) -> str:
    """The same test as DuckDB SQL."""
    f, v = find.replace("'", "''"), void.replace("'", "''")
    at = "CAST(list_sum(list_transform(rest[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS INTEGER)"
    first = f"greatest({at} - {before}, 0)"
    near = f"substr(t, {first} + 1, {at} + length(hits[k]) - {first} + {after})"
    voids = f"len(list_filter(range(1, len(hits) + 1), lambda k: regexp_matches({near}, '{v}')))"
    test = f"len(hits) > 0 AND {voids} = len(hits)" if need_all else f"len(hits) > {voids}"
    return f"(SELECT {test} FROM (SELECT {text} AS t, regexp_extract_all({text}, '{f}') AS hits, string_split_regex({text}, '{f}') AS rest))"


#: Rules that look around each hit: what is found, what voids it, how far before and after, and whether all must be void.
REMOTE_HEDGED = (pattern_of(terms_of("remote")), pattern_of(terms_of("hedge")), 90, 40, True)
OTHER_LANGUAGE = (pattern_of(terms_of("language_required")), pattern_of(terms_of("english")), 160, 160, False)
OFFICE_DAYS = (r"(?:^|\D)[1-5]\s*(?:days?|tage?|jours?|d[ií]as?)\s+(?:a|per|in|pro|par|por|im|au|en)\s[^.]{0,30}(?:office|week|büro|woche|bureau|semaine|oficina|semana)|\d{1,3}\s*%\s*(?:in the office|on-?site|im büro)", r"hybrid (?:cloud|car|app)|days ago", 60, 60, False)
MANY_YEARS = (r"(?:^|\D)(?:[3-9]|1\d)\s*(?:\+|or more|to \d+|[-–]\s*\d+)?\s*years?(?:$|[^a-z])", r"years? old|founded|since|not required|no experience|nice to have", 60, 60, False)


def only_hedged_remote(text: Column) -> Column:
    """Every mention of remote work has a hedge near it."""
    return around_hits(text, *REMOTE_HEDGED)


def asks_other_language(text: Column) -> Column:
    """A language is asked for, and English is not named near it."""
    return around_hits(text, *OTHER_LANGUAGE)


def asks_office_days(text: Column) -> Column:
    """Days in the office are asked for, and nothing near tells of something else."""
    return around_hits(text, *OFFICE_DAYS)


def asks_years(text: Column) -> Column:
    """Years of experience beyond a junior's are asked for, and the text around does not waive them or speak of an age."""
    return around_hits(text, *MANY_YEARS)


def silent_about_english(text: Column, language: Column, thin: Column) -> Column:
    """A posting in another language whose own text never names English; thin ones and unknown languages are not silent."""
    foreign = ~F.coalesce(language, F.lit("unknown")).isin("en", "unknown", "")
    return ~F.coalesce(thin, F.lit(False)) & foreign & ~hit(text, "english")


def english_density(text: Column, squeezed_already: bool = False) -> Column:
    """English by its function words: texts of under 40 words count as English, else 8 of 100 words must be markers."""
    words = F.filter(F.split(text if squeezed_already else squeezed(text), "[^a-z]+"), lambda w: w != "")
    n = F.size(words)
    return (n < FEW_WORDS) | (F.size(F.filter(words, lambda w: w.isin(*MARKERS["en"]))) * 100 >= n * MARKERS_OF_100)


def detected_language(text: Column) -> Column:
    """The language with the most function words, ``unknown`` below 40 characters or without any."""
    words = F.split(squeezed(text), r"[^\p{L}]+")
    seen = lambda markers: F.size(F.filter(words, lambda w: w.isin(*markers)))
    counts = F.array(*[F.struct(seen(m).alias("n"), F.lit(k).alias("lang")) for k, m in sorted(MARKERS.items(), reverse=True)])
    best = F.array_max(counts)
    return F.when((F.length(F.trim(F.coalesce(text, F.lit("")))) < 40) | (best["n"] == 0), F.lit("unknown")).otherwise(best["lang"])


def fake_reasons(company: Column, body: Column, url: Column, thin: Column) -> Column:
    """How many signs of a fake: no company, a missing or tiny body that is not just thin, no url, each suspicious phrase."""
    text = F.lower(F.coalesce(body, F.lit("")))
    phrases = sum(text.contains(p).cast("int") for p in terms_of("suspicious"))
    tiny = (F.length(F.trim(F.coalesce(body, F.lit("")))) < 50) & ~F.coalesce(thin, F.lit(False))
    return (F.trim(F.coalesce(company, F.lit(""))) == "").cast("int") + tiny.cast("int") + (F.trim(F.coalesce(url, F.lit(""))) == "").cast("int") + phrases


def is_gone(body: Column) -> Column:
    """A notice that the posting is gone within the first 600 characters, white space counted once, or the text of an index."""
    return says_gone(body) | is_index_text(body)


def says_gone(body: Column, squeezed_already: bool = False) -> Column:
    return hit(F.substring(body if squeezed_already else squeezed(body), 1, GONE_CHARS), "gone")


def is_index_text(body: Column) -> Column:
    """Many tags in brackets, or a phrase of an index within the first 2,000 characters."""
    text = F.coalesce(body, F.lit(""))
    return (F.regexp_count(text, F.lit(TAG)) >= INDEX_TAGS) | F.substring(F.lower(text), 1, INDEX_CHARS).rlike(INDEX_PHRASE)


def is_single_posting(url: Column) -> Column:
    """In this order: an id makes a posting, a list's end does not, a long slug that does not speak of jobs does."""
    u, path = F.lower(F.coalesce(url, F.lit(""))), F.lower(url_page(url))
    slug = F.regexp_extract(path, r"/([^/]+)/?$", 1)
    return F.when(u.rlike(ID_PARAMETER) | path.rlike(r"/\d{4,}(?:/|$)"), True).when(path.rlike(LIST_END), False).when(slug.rlike(r"^[0-9a-f]{8,}$|-\d{4,}$"), True).otherwise(slug.rlike(r"^[^-]+(?:-[^-]+){3,}$") & ~slug.contains("jobs"))


def is_listing_page(url: Column, title: Column) -> Column:
    return F.when(squeezed(title).rlike(COUNTED_TITLE), True).when(is_single_posting(url), False).otherwise(F.lower(url_page(url)).rlike(LIST_END))


def is_editorial(url: Column, title: Column) -> Column:
    path = F.lower(url_page(url))
    return F.when(path.rlike(JOB_PATH), False).otherwise(path.rlike(EDITORIAL_PATH) | squeezed(title).rlike(EDITORIAL_TITLE))


def is_error_page(title: Column, body: Column) -> Column:
    """A bare three-digit title, or a short body that it or its title says is blocked."""
    t, b = squeezed(title), F.coalesce(body, F.lit(""))
    return t.rlike(r"^\d{3}$") | ((F.length(b) < 1200) & (F.lower(b).rlike(BLOCKED) | t.rlike(BLOCKED)))


def posting_words(body: Column) -> Column:
    """At least three terms of a posting's vocabulary."""
    return F.regexp_count(F.lower(F.coalesce(body, F.lit(""))), F.lit(pattern_of(terms_of("posting")))) >= 3


def in_field(title: Column, wanted: list[str]) -> Column:
    """Every word of some wanted title starts a word of the title; words of up to three letters are whole words."""
    t = squeezed(title)
    forms = [[pattern_of([w]) for w in name.lower().split()] for name in wanted]
    named = F.lit(False)
    for words in forms:
        every = F.lit(True)
        for w in words:
            every = every & t.rlike(w)
        named = named | every
    return (t == "") | named


def in_places(country: Column, wanted: list[str]) -> Column:
    """Strict: some country of the comma-separated value is wanted; a missing country goes. Nothing wanted keeps all."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.transform(F.split(country, ","), lambda c: F.trim(c)), F.array(*map(F.lit, wanted))), F.lit(False))


def chosen(value: Column, wanted: list[str]) -> Column:
    """One of the wanted values or blank; nothing wanted keeps all."""
    return F.lit(True) if not wanted else F.coalesce(value, F.lit("")).isin("", *wanted)


def reaches(score: Column, floor: int | None) -> Column:
    """A score of at least the floor; rows without a score stay, a floor of 0 or none keeps all."""
    return F.lit(True) if not floor or floor <= 0 else score.isNull() | (score >= floor)


def quoted(quote: Column, *texts: Column, least: int = 6) -> Column:
    """The quote, letters and digits only and not under six of them, is part of the texts put together."""
    q = alnum_only(quote)
    return (F.length(q) >= least) & F.concat(*map(alnum_only, texts)).contains(q)


def matches_glob(url: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.coalesce(url, F.lit("")).rlike(glob_pattern(g))
    return out


def on_board(url: Column, brands: list[str]) -> Column:
    out = F.lit(False)
    for b in brands:
        out = out | url_host(url).contains(b)
    return out


def category(title: Column, body: Column, employment: Column, squeezed_already: bool = False) -> Column:
    """Thesis, PhD, Internship or Part-Time by title, then by body, then by the platform's word, else Full-Time."""
    t, b = (title, body) if squeezed_already else (squeezed(title), squeezed(body))
    names = (("Thesis", "thesis"), ("PhD", "phd"), ("Internship", "internship"), ("Part-Time", "part_time"))
    out = F.when(F.lit(False), F.lit(""))
    for text in (t, b):
        for name, section in names:
            out = out.when(hit(text, section), name)
    word = F.lower(F.coalesce(employment, F.lit("")))
    return out.when(word.contains("contract"), "Contract").when(word.contains("temp"), "Temporary").otherwise("Full-Time")


def category_uncertain(title: Column, body: Column, employment: Column, language: Column) -> Column:
    """Nothing told the category: no words, no kind of employment, and a text in a language other than English."""
    return uncertain_of(category(title, body, F.lit("")), employment, language)


def uncertain_of(by_words: Column, employment: Column, language: Column) -> Column:
    """The same from a category that was found by words alone, so that no text is read again."""
    return (by_words == "Full-Time") & (F.trim(F.coalesce(employment, F.lit(""))) == "") & ~F.coalesce(language, F.lit("unknown")).isin("en", "unknown")


def shown_category(category: Column, stage: Column) -> Column:
    """The category as shown: blank ones are Other, those of start-ups say so."""
    return F.concat(F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("Other")), F.when(stage == "startup", " Startup").otherwise(""))


def chrome_only(body: Column) -> Column:
    """A text that holds a page's furniture only: empty, an index, or short and without a posting's words."""
    text = F.coalesce(body, F.lit(""))
    return F.when(F.trim(text) == "", True).when(is_index_text(text), True).when(F.length(text) >= 2400, False).otherwise(~posting_words(text))


#: The order of the categories; others come after.
CATEGORIES = ("Thesis", "PhD", "Internship", "Part-Time", "Full-Time")


def category_rank(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.coalesce(c, F.lit(""))), F.lit(0)), F.lit(len(CATEGORIES) + 1))


def seniority(title: Column, level: Column) -> Column:
    """By the title's words in falling order, then the platform's field, else Unspecified."""
    t, f = squeezed(title), F.lower(F.coalesce(level, F.lit("")))
    return (
        F.when(t.rlike(pattern_of(["lead", "head of", "principal"])), "Lead")
        .when(hit(t, "senior"), "Senior")
        .when(t.rlike(pattern_of(["mid-level", "intermediate"])), "Mid")
        .when(t.rlike(pattern_of(["junior", "graduate", "entry"])), "Junior")
        .when(hit(t, "internship"), "Intern")
        .when(f.contains("senior"), "Senior")
        .when(f.contains("junior") | f.contains("entry"), "Junior")
        .otherwise("Unspecified")
    )


def english_need(text: Column, language: Column) -> Column:
    """English only, English + Other, or Other only, from what the text asks for."""
    other, named = hit_by_language(text, language, "language_required"), hit(text, "english")
    return F.when(other & named, "English + Other").when(other, "Other only").otherwise("English only")


SECTIONS = tuple(TERMS)
