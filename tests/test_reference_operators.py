"""The library's own operators: tables of cases, brute force and invariants."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions.dates import MONTHS, NOT_CUT, age_days, not_stale, posted_at, within_window


def values(spark, cases, make, schema="a string"):
    """make(columns...) over rows of cases, in order."""
    df = spark.createDataFrame([(k, *c) if isinstance(c, tuple) else (k, c) for k, c in enumerate(cases)], f"k int, {schema}")
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.orderBy("k").select(make(*cols)).collect()]


def test_text_functions(spark):
    assert values(spark, ["Acme G.m.b.H.", "The  Big-Co, Inc.", None, "SAS"], T.company_norm) == ["acme", "the big", "", ""]
    assert values(spark, ["Acme Group GmbH", "AB", None, "Müller Ltd"], T.company_key) == ["acme", "", "", "mller"]
    assert values(spark, ["https://www.a.com/x", "HTTP://B.org:80?q", "no url", None], T.url_host) == ["a.com", "b.org", "", ""]
    assert values(spark, ["http://a/b/?q#f", "http://a/en/b/", "http://a/engine"], T.url_identity) == ["http://a/b", "http://a/b", "http://a/engine"]
    assert values(spark, ["<p>a<br>b</p>", None, "x < y"], T.strip_html) == ["a b", "", "x < y"]
    assert values(spark, ["Data Engineer (m/w/d) | Acme Jobs", "Data Engineer", "Data  Engineer [Berlin]", None], T.dedup_title_key) == ["data engineer"] * 3 + [""]
    assert values(spark, [("Acme - Engineer - Berlin", "Acme"), ("Engineer | ACME", "acme"), ("Engineer", "Engineer"), ("A | acme", "acme")], T.site_tail_removed, "a string, b string") == ["Engineer - Berlin", "Engineer", "Engineer", "A | acme"]
    assert values(spark, ["note $$gone: x$$", "a $$b$$ c", None], T.drop_note_removed) == ["note", "a $$b$$ c", ""]
    import re

    assert [bool(re.search(T.glob_pattern("https://*.a.com/**/x"), u)) for u in ("https://b.a.com/1/2/x", "https://b.c.a.com/1/x", "https://b/c.a.com/1/x", "https://b.a.com/x")] == [True, True, False, False]
    assert values(spark, ["a &amp; b", "&lt;&eacute;", None], T.unescaped) == ["a & b", "<é", None]


NOW = "2024-03-10 12:00:00"


#: Raw dates and what they mean at NOW.
DATES = [
    ("2024-03-01", "2024-03-01 00:00:00"), ("2024-03-01T10:30:00Z", "2024-03-01 10:30:00"), ("1709251200", "2024-03-01 00:00:00"), ("1709251200000", "2024-03-01 00:00:00"),
    ("1.3.2024", "2024-03-01 00:00:00"), ("13/02/2024", "2024-02-13 00:00:00"), ("02/13/2024", "2024-02-13 00:00:00"), ("03/02/2024", "2024-02-03 00:00:00"), ("1.3.24", "2024-03-01 00:00:00"),
    ("Posted on: March 1st, 2024", "2024-03-01 00:00:00"), ("1 März 2024", "2024-03-01 00:00:00"), ("1 de marzo de 2024", "2024-03-01 00:00:00"), ("1er mars 2024", "2024-03-01 00:00:00"), ("Mar 1, 2024", "2024-03-01 00:00:00"),
    ("today", NOW), ("gestern", "2024-03-09 12:00:00"), ("3 days ago", "2024-03-07 12:00:00"), ("vor 2 Wochen", "2024-02-25 12:00:00"), ("a month ago", "2024-02-09 12:00:00"), ("2 settimane fa", "2024-02-25 12:00:00"), ("5 hours ago", "2024-03-10 07:00:00"),
    ("deadline 2024-02-28 at noon", "2024-02-28 00:00:00"), ("nan", None), ("", None), (None, None), ("-", None), ("soon", None), ("99.99.2024", None),
    ("2024-02", "2024-02-01 00:00:00"), ("02/2024", "2024-02-01 00:00:00"), ("20240213", "2024-02-13 00:00:00"), ("20240213T101112", "2024-02-13 10:11:12"), ("13.02.2024 14:30", "2024-02-13 14:30:00"), ("2024/2/13 4:05:06", "2024-02-13 04:05:06"),
    ("31-12-69", "1969-12-31 00:00:00"), ("45-12-31", "2045-12-31 00:00:00"), ("30.02.2024", None), ("13 02 2024", "2024-02-13 00:00:00"),
    ("February 2024", "2024-02-01 00:00:00"), ("Mon, 5 Feb 2024", "2024-02-05 00:00:00"), ("5-Feb-24", "2024-02-05 00:00:00"), ("Feb 5, 2024 14:30", "2024-02-05 14:30:00"), ("Stellenangebot vom 05.02.2024, Vollzeit", "2024-02-05 00:00:00"),
    ("5. Dezember 2023", "2023-12-05 00:00:00"), ("den 5 december 2023", "2023-12-05 00:00:00"), ("5. desember 2023", "2023-12-05 00:00:00"), ("5. joulukuuta 2023", "2023-12-05 00:00:00"), ("5 grudnia 2023", "2023-12-05 00:00:00"), ("5 wrzesnia 2023", "2023-09-05 00:00:00"), ("5 de março de 2024", "2024-03-05 00:00:00"), ("5. marts 2024", "2024-03-05 00:00:00"), ("5 sept. 2023", "2023-09-05 00:00:00"),
    ("für 3 veckor sedan", "2024-02-18 12:00:00"), ("5 päivää sitten", "2024-03-05 12:00:00"), ("5 paivaa sitten", "2024-03-05 12:00:00"), ("2 tygodnie temu", "2024-02-25 12:00:00"), ("há 2 meses", "2024-01-10 12:00:00"), ("i går", "2024-03-09 12:00:00"), ("wczoraj", "2024-03-09 12:00:00"), ("30+ days ago", "2024-02-09 12:00:00"), ("vor einem Tag", "2024-03-09 12:00:00"),
    ("new", NOW), ("posted today at 9", NOW), ("new york", None), ("sieben Tagen", None), ("marching 5 2024", None), ("Mar 5, 14:30", None),
]


def test_dates(spark):
    got = values(spark, [raw for raw, _ in DATES], lambda c: posted_at(c, F.lit(NOW).cast("timestamp")).cast("string"))
    assert [(raw, g) for (raw, _), g in zip(DATES, got, strict=True)] == DATES


def test_no_spelling_of_a_month_means_two():
    said: dict[str, set[int]] = {}
    for language, names in MONTHS.items():
        for number, name in enumerate(names, 1):
            for cut in {name, name[:4]} | ({name[:3]} if language not in NOT_CUT else set()):
                said.setdefault(cut, set()).add(number)
    assert {cut: numbers for cut, numbers in said.items() if len(numbers) > 1} == {}


def test_date_windows_differ_at_their_edge(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    posted = ["2024-03-03 07:00:00", "2024-03-03 13:00:00", None, "2024-03-11 00:00:00"]
    ts = lambda c: c.cast("timestamp")
    assert values(spark, posted, lambda c: age_days(ts(c), now)) == [7, 6, None, 0]
    assert values(spark, posted, lambda c: within_window(ts(c), now, 7)) == [False, True, True, True]
    assert values(spark, posted, lambda c: not_stale(ts(c), now, 7)) == [True, True, True, True]


def test_predicates(spark):
    from siftmill.operators import predicates as P

    none = F.lit(None).cast("string")
    work = lambda mode: lambda a, tag, thin: P.work_location(F.lower(a), tag, thin, mode)
    cases = [("fully remote role", None, None), ("in the office", None, None), ("no remote, sorry", None, None), ("silent", None, None), ("silent", None, True), ("remote", "Hybrid", None), ("silent", "Remote", None)]
    schema = "a string, b string, c boolean"
    assert values(spark, cases, work("remote"), schema) == [True, False, False, False, True, False, True]
    assert values(spark, cases, work("not_remote"), schema) == [False, True, True, True, True, True, False]
    assert values(spark, cases, work("any"), schema) == [True] * 7
    fake = lambda a, b, c, d: P.fake_reasons(a, b, c, d) >= 2
    long = "a decent description of the position and its many duties"
    assert values(spark, [("Acme", long, "http://x", None), (None, long, "http://x", None), (None, "", "http://x", None), (None, "", "u", True), ("A", "quick money " + long, "", None)], fake, "a string, b string, c string, d boolean") == [False, False, True, False, True]
    assert values(spark, ["This position has been filled.", "x" * 700 + " expired", "[a] [b] [c] [d] [e] [f] [g] [h]", None], P.is_gone) == [True, False, True, False]
    urls = ["https://a.com/jobs/12345", "https://a.com/careers/", "https://a.com/x?jobid=7", "https://a.com/senior-data-engineer-berlin", "https://a.com/all-the-jobs-in-berlin", "https://a.com/about", None]
    assert values(spark, urls, P.is_single_posting) == [True, False, True, True, False, False, False]
    assert values(spark, [("https://a.com/careers", "120 jobs in Berlin"), ("https://a.com/jobs/12345", "Engineer"), ("https://a.com/jobs", "Work here")], P.is_listing_page, "a string, b string") == [True, False, True]
    assert values(spark, [("https://a.com/blog/x", "t"), ("https://a.com/jobs/blog", "How to"), ("https://a.com/x", "How to apply")], P.is_editorial, "a string, b string") == [True, False, True]
    assert values(spark, [("404", "x"), ("Engineer", "Access denied"), ("Engineer", "x" * 2000 + "captcha")], P.is_error_page, "a string, b string") == [True, True, False]
    assert values(spark, ["Data Engineer", "Engineering of data", "Database expert", None], lambda a: P.in_field(a, ["data engineer"])) == [True, True, False, True]
    assert values(spark, ["Germany, Austria", "France", None], lambda a: P.in_places(a, ["Austria"])) == [True, False, False]
    assert values(spark, ["Yes", "", None, "No"], lambda a: P.chosen(a, ["Yes"])) == [True, True, True, False]
    assert values(spark, [("must speak ENGLISH!", "You must speak English daily"), ("a b", "a b"), ("not there at all", "x")], P.quoted, "a string, b string") == [True, False, False]
    assert values(spark, ["remote possible after probation, occasionally", "fully remote", "on site"], P.only_hedged_remote) == [True, False, False]
    assert values(spark, ["fluent german", "fluent german or english", None], P.asks_other_language) == [True, False, False]
    assert values(spark, ["3 days a week in the office", "2 days per week, hybrid cloud", "remote"], P.asks_office_days) == [True, False, False]
    assert values(spark, ["at least 5+ years", "3 years old company", "no experience"], P.asks_years) == [True, False, False]
    assert values(spark, [("Master thesis", "x"), ("Engineer", "an internship"), ("Engineer", "y")], lambda a, b: P.category(a, b, none), "a string, b string") == ["Thesis", "Internship", "Full-Time"]
    assert values(spark, ["Head of Data", "Senior Engineer", "Junior Analyst", "Intern", "Engineer"], lambda a: P.seniority(a, none)) == ["Lead", "Senior", "Junior", "Intern", "Unspecified"]


def test_accents_do_not_change_a_hit_and_short_terms_are_whole_words(spark):
    from siftmill.functions.vocabulary import hit, pattern_of

    assert values(spark, ["du télétravail", "du teletravail", "preremote", "über remote"], lambda a: hit(a, "remote")) == [True, True, False, True]
    assert values(spark, ["an ai job", "an air job", "ai"], lambda a: a.rlike(pattern_of(["ai"]))) == [True, False, True]


def test_bound_of_shared_words_drops_nothing_that_is_alike(spark):
    from siftmill.functions.similarity import token_set
    from siftmill.operators.survivorship import joined_length, may_be_alike, sized_words

    rng = random.Random(17)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    pairs = [(k, *(" ".join(rng.choice(words[: rng.randint(1, 40)]) for _ in range(rng.randint(1, 30))) for _ in range(2))) for k in range(800)]
    df = spark.createDataFrame(pairs, "k int, a string, b string").select("k", "a", "b", sized_words(F.col("a")).alias("x"), sized_words(F.col("b")).alias("y"))
    kept = {r["k"] for r in df.filter(may_be_alike(F.col("x"), F.col("y"), joined_length(F.col("x")), joined_length(F.col("y")), 80)).collect()}
    alike = {k for k, a, b in pairs if token_set(a, b) >= 80}
    assert alike <= kept and alike and len(kept) < len(pairs)


def test_quotes_in_texts_both_ways(spark):
    from siftmill.operators.joins import containing, containing_by_join

    rng = random.Random(23)
    draw = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    texts = [draw(rng.randint(0, 400)) for _ in range(60)] + ["", "abcdef"]
    quotes = [draw(rng.randint(6, 12)) for _ in range(30)] + [texts[0][5:60], "abcdef", "abc", texts[1]]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, q string").withColumn("item_id", F.col("item_id").cast("int"))
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(99, None)], "doc_id long, t string")
    want = sorted((i, d) for i, x in enumerate(quotes) for d, y in enumerate(texts) if len(x) >= 6 and x in y)
    assert sorted(map(tuple, containing(q, t).collect())) == want
    assert sorted(map(tuple, containing_by_join(q.filter("length(q) >= 6"), t).collect())) == want
    assert containing(q.filter("item_id < 0"), t).count() == 0


def test_first_wins_keeps_blank_keys_and_bears_a_hot_one(spark):
    from siftmill.operators.survivorship import first_wins

    df = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else "", {"m": k}) for k in range(300)], "id int, k string, tags map<string,int>")
    out = first_wins(df, F.col("k"), [-F.col("id")]).collect()
    assert sorted(r["id"] for r in out) == sorted([299, *range(0, 300, 3)])
    assert sorted(r["id"] for r in first_wins(df, F.col("k"), [F.col("id")], keep_blank=False).collect()) == [0, 1, 3]


def test_notice_of_removal_after_blanks(spark):
    from siftmill.operators.predicates import is_gone

    texts = ["\n " * 350 + "This position is no longer available", "x" * 601 + " no longer available", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["g"] for r in df.orderBy("k").select(is_gone(F.col("t")).alias("g")).collect()] == [True, False, False]


def test_similarities():
    from siftmill.functions.similarity import common_subsequence, matching_blocks, ratio, token_set

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert common_subsequence(a, b) == slow(a, b)
    from siftmill.functions.similarity import common_subsequence_from

    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abcd") for c in a)[: rng.randint(0, 60)]
        whole, least = common_subsequence(a, b), rng.randint(0, 60)
        for strip in (1, 7, 192):
            got = common_subsequence_from(a, b, least, strip)
            assert got == whole if whole >= least else got < least
    assert ratio("", "") == 100 and ratio("ab", "ab") == 100 and ratio("ab", "cd") == 0
    assert token_set("a b c", "c b") == 100 and token_set("", "a") == 0

    def plain_token_set(a, b):
        x, y = set(a.split()), set(b.split())
        both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and (not left or not right):
            return 100.0
        first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
        return max(ratio(first, second), *((ratio(both, first), ratio(both, second)) if both else (0.0,)))

    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    for _ in range(400):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(2))
        want = plain_token_set(a, b)
        assert abs(token_set(a, b) - want) < 1e-9
        assert abs(token_set(a, b, 70.0) - (want if want >= 70 else 0)) < 1e-9
    assert abs(token_set("new york mets", "new york yankees") - ratio("new york mets", "new york yankees")) < 1e-9 or token_set("new york mets", "new york yankees") > 70
    assert matching_blocks("acme systems", "acme system") > 0.9 and matching_blocks("acme", "zebra") == 0


def test_similar_strings_loses_no_pair(spark):
    from siftmill.functions.similarity import ratio
    from siftmill.operators.survivorship import similar_strings

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 30))) for _ in range(40)]
    edited = ["".join(c for c in s if rng.random() > 0.06) + rng.choice(["", "x", "yz"]) for s in base for _ in range(3)]
    words = sorted({*base, *edited} - {""})
    want = sorted(p for p in itertools.combinations(words, 2) if ratio(*p) >= 90)
    got = similar_strings(spark.createDataFrame([(w,) for w in words], "t string"), "t", 90)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 30


def test_fuzzy_register_loses_no_name(spark):
    from siftmill.functions.similarity import block_ratio, matching_blocks
    from siftmill.operators.joins import fuzzy_register

    rng = random.Random(8)
    legal = sorted({"".join(rng.choice("abcdef ") for _ in range(rng.randint(18, 34))).strip() for _ in range(40)})
    names = {f"{x[0]}#{x[2:-2]}#{x[-1]}" for x in legal}  # a letter near each end is another
    for x in legal:
        k = rng.randrange(len(x))
        names |= {x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], "y" + x[1:-1] + "y"}
    names |= {"", "a", legal[0], "northern widgets and tools ltd"}
    best = lambda n: max((matching_blocks(n, x) if n != x else 1.0, x) for x in legal)
    want = sorted((n, best(n)[1], round(best(n)[0], 9)) for n in names if best(n)[0] >= 0.9)
    out = fuzzy_register(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), spark.createDataFrame([(x,) for x in legal], "legal string"), "name", "legal", block_ratio, 0.90)
    assert sorted((r["name"], r["legal"], round(r["similarity"], 9)) for r in out.collect()) == want
    assert sum("#" in n for n, *_ in want) == len([x for x in legal if 2 * (len(x) - 2) / (2 * len(x)) >= 0.9])


def test_greedy_equals_the_sequential_walk(spark):
    from siftmill.operators.survivorship import greedy

    rng = random.Random(3)
    for n, m in ((12, 14), (40, 90), (30, 0)):
        ranks = rng.sample(range(1000), n)
        edges = [tuple(rng.sample(range(n), 2)) for _ in range(m)]
        kept = set()
        for k in sorted(range(n), key=ranks.__getitem__):
            if not any((a == k and b in kept) or (b == k and a in kept) for a, b in edges):
                kept.add(k)
        rows = spark.createDataFrame([(k, ranks[k]) for k in range(n)], "id int, rank int")
        got = greedy(rows, spark.createDataFrame(edges, "a int, b int"))
        assert {r["id"] for r in got.collect()} == kept


def test_dedup_text_greedy_matches_brute_force(spark):
    from siftmill.functions.similarity import ratio, token_set
    from siftmill.operators.survivorship import dedup_text_greedy

    rng = random.Random(5)
    titles = ["data engineer berlin", "data engineers berlin", "data engineer berlin x", "nurse", "", "nurses"]
    bodies = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "one two three", "one two three four", ""]
    data = [(k, rng.choice(titles), rng.choice(bodies), rng.randint(0, 1), rng.randint(0, 3), 1) for k in range(60)]
    kept = []
    for row in sorted(data, key=lambda r: (-r[3], -r[4], -r[5], r[0])):
        like = lambda o, r=row: o[1] and o[2] and r[1] and r[2] and ratio(o[1], r[1]) >= 90 and (o[2] == r[2] or token_set(o[2], r[2]) >= 80)
        if not any(like(o) for o in kept):
            kept.append(row)
    df = spark.createDataFrame(data, "id int, title_key string, body string, q1 int, q2 int, q3 int")
    assert sorted(r["id"] for r in dedup_text_greedy(df).collect()) == sorted(r[0] for r in kept)


def test_first_wins_and_pools(spark):
    from siftmill.sources.sinks import export_cells, finite, upserted

    pool = spark.createDataFrame([(1, "u1", "old"), (2, "", "a"), (3, None, "b")], "row_id int, url string, t string")
    new = spark.createDataFrame([(9, "u1", "new"), (2, "", "again")], "row_id int, url string, t string")
    assert sorted((r["row_id"], r["t"]) for r in upserted(pool, new).collect()) == [(2, "again"), (3, "b"), (9, "new")]
    odd = spark.createDataFrame([(float("nan"), "a\x00b"), (float("inf"), "x" * 40_000), (1.5, None)], "v double, s string")
    assert [r["v"] for r in finite(odd).collect()] == [None, None, 1.5]
    cells = export_cells(odd).collect()
    assert cells[0]["s"] == "a b" and cells[1]["s"].endswith(" [cut]") and len(cells[1]["s"]) < 32_767 and cells[2]["s"] is None


def test_sources_are_normalised(spark):
    from siftmill.sources.normalise import SOURCES, collected, normalised

    raw = {
        "se_board": {"hits": [{"headline": "Dev", "employer": {"name": "A"}, "workplace_address": {"municipality": "Lund"}, "publication_date": "2024-01-02T03:04:05", "webpage_url": "http://s/1", "description": {"text": "<b>x</b> y"}}]},
        "de_board": {"ergebnisliste": [{"stellenangebotsTitel": "Entwickler", "firma": "B", "referenznummer": "r1", "stellenlokationen": [{"adresse": {"ort": "Bonn"}}]}, {"stellenangebotsTitel": "ohne"}]},
        "network": [{"title": "Eng", "companyName": "C", "link": "http://s/1", "employmentType": "FULL TIME", "workplaceType": "Telecommute"}],
        "portal": [{"positionName": "Ops", "location": {"city": "Rome"}, "url": "", "jobType": "contract"}],
        "web_search": {"organicResults": [{"title": "T", "url": "http://w", "description": "snippet", "websiteContent": {"text": ""}}]},
    }
    rows = {k: normalised(spark.createDataFrame([(json.dumps(v),), ("{broken",)], "item string"), SOURCES[k]) for k, v in raw.items()}
    one = {k: [r for r in df.collect() if r["problem"] is None] for k, df in rows.items()}
    assert [(r["title"], r["location"], r["description"], r["country"]) for r in one["se_board"]] == [("Dev", "Lund", "x y", "Sweden")]
    assert [(r["title"], r["location"], r["thin"]) for r in one["de_board"]] == [("Entwickler", "Bonn", True)]
    assert [(r["employment_type"], r["workplace_type"]) for r in one["network"]] == [("Full-time", "Remote")]
    assert [(r["location"], r["employment_type"]) for r in one["portal"]] == [("Rome", "Contract")]
    assert one["web_search"][0]["description"] == "snippet"
    assert all([r["problem"] for r in df.collect() if r["problem"]] == ["{broken"] for df in rows.values())
    together = collected([df.filter("problem IS NULL") for df in rows.values()])
    assert sorted(r["title"] for r in together.collect()) == ["Dev", "Entwickler", "Ops", "T"]


def test_registers(spark, tmp_path):
    from siftmill.sources.registers import current_version, names_of_table, register_from_csv

    (tmp_path / "r.csv").write_text("Name,Town\nAcme,X\nAcme,Y\n Beta ,Z\n,Q\n")
    assert sorted(r["name"] for r in register_from_csv(spark, str(tmp_path / "r.csv"), "Name", 2).collect()) == ["Acme", "Beta"]
    with pytest.raises(ValueError):
        register_from_csv(spark, str(tmp_path / "r.csv"), "Name", 3)
    page = spark.createDataFrame([("<table><tr><th>Name</th></tr><tr><td><a>Acme</a> Co</td><td>1</td></tr></table>",)], "html string")
    assert sorted(r["name"] for r in names_of_table(page).collect()) == ["Acme Co", "Name"]
    versions = spark.createDataFrame([("NL", "A", "2024-01-01"), ("NL", "B", "2024-02-01"), ("UK", "C", "2023-01-01")], "country string, name string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert sorted((r["country"], r["name"], r["stale"]) for r in current_version(versions, "2024-02-10").collect()) == [("NL", "B", False), ("UK", "C", True)]


def test_html_text_and_structured_postings():
    from siftmill.functions.html import posting_of, readable

    told = "A long description of the work. " * 10
    page = f'<html><head><script type="application/ld+json">{{"@graph": [{{"@type": ["JobPosting"], "description": "&lt;p&gt;{told}"}}]}}</script></head><body><nav>Menu</nav><p>Short</p><script>x</script></body></html>'
    assert posting_of(page)["@type"] == ["JobPosting"] and readable(page).startswith("A long description")
    assert readable("<nav>a</nav><p>b &amp; c</p><footer>d</footer>") == "b & c" and readable(None) == "" and posting_of("<script type='application/ld+json'>{bad</script>") is None


def test_joins(spark):
    from siftmill.functions.similarity import block_ratio
    from siftmill.operators import joins as J

    names = spark.createDataFrame([("acme systems",), ("acme systemz",), ("zebra",)], "name string")
    register = spark.createDataFrame([("acme systems",), ("other",)], "legal string")
    got = {r["name"]: r["legal"] for r in J.fuzzy_register(names, register, "name", "legal", block_ratio, 0.9).collect()}
    assert got == {"acme systems": "acme systems", "acme systemz": "acme systems"}
    pages = spark.createDataFrame([(1, "a.b.com"), (2, "b.com"), (3, "xb.com")], "page_id int, host string")
    known = spark.createDataFrame([("b.com",), ("a.b.com",)], "domain string")
    assert {r["page_id"]: r["domain"] for r in J.by_domain_suffix(pages, known, "page_id", F.col("host")).collect()} == {1: "a.b.com", 2: "b.com"}
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    quotes = [t[k : k + n] for t in texts for k, n in ((0, 6), (5, 24), (3, 60)) if len(t) > 70] + ["zzzzzzzz", "abc"]
    got = J.containing(spark.createDataFrame(list(enumerate(quotes)), "item_id int, q string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string"))
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == sorted((i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if len(q) >= 6 and q in t)


def test_links(spark):
    from siftmill.operators.links import first_links, link_shapes, proposed_globs, url_prefixes

    html = "".join(f'<a href="/jobs/{k}">x</a>' for k in range(4)) + '<a href="/about">y</a><a href="/jobs/0">again</a>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r["shape"], r["links"]) for r in link_shapes(pages).collect()] == [("/a/0", 4)]
    assert [r["href"] for r in first_links(pages, 2).orderBy("pos").collect()] == ["/jobs/0", "/jobs/1"]
    urls = spark.createDataFrame([(f"http://a.com/jobs/{k}?q",) for k in range(5)] + [("http://a.com/",)], "url string")
    found = {r["prefix"]: (r["support"], r["usual_depth"]) for r in url_prefixes(urls).collect()}
    assert found["jobs"] == (5, 2) and found["jobs/3"] == (1, 2)
    assert [r["glob"] for r in proposed_globs(urls).collect()] == ["**/jobs/*"]


POSTING = "row_id int, title string, company string, description string, url string, country string, lang string, thin boolean, workplace string, sponsorship string, posted_raw string, score int"


def pool(spark):
    base = dict(company="Acme", url="http://a/jobs/1", country="Germany", lang="en", thin=None, workplace=None, sponsorship=None, posted_raw=None, score=None)
    long = "We look for somebody with experience who writes good code and tests it well, in a friendly team."
    rows = [
        dict(title="Engineer", description=long + " Fully remote."), dict(title="Engineer", description=long + " Office based."), dict(title="Engineer", description=long + " Fluent German is needed."),
        dict(title="Engineer", description=long + " We cannot sponsor."), dict(title="Intern", description=long + " This is unpaid."), dict(title="Old", description=long, posted_raw="2023-01-01"),
        dict(title=None, company=None, description=None, url=None, country=None, lang=None), dict(title="Weak", description=long, score=10), dict(title="Engineer", description=long, country="Spain"),
    ]
    names = [c.split()[0] for c in POSTING.split(", ")]
    return spark.createDataFrame([tuple({**base, **r, "row_id": k}.get(n) for n in names) for k, r in enumerate(rows)], POSTING)


def test_filter_chain_golden_idempotent_and_monotone(spark):
    from siftmill.plans.chains import Choices, accounting, kept, with_reason

    rows = pool(spark)
    full = Choices(mode="any", countries=("Germany",), days=60, floor=50)
    reasons = {r["row_id"]: r["drop_reason"] for r in with_reason(rows, full).collect()}
    assert reasons == {0: None, 1: None, 2: "language", 3: "no sponsorship", 4: "unpaid", 5: "date", 6: "fake", 7: "match", 8: "place"}
    assert {r["reason"]: r["n"] for r in accounting(rows, full).collect()}["kept"] == 2
    once = kept(rows, full)
    assert kept(once, full).count() == once.count() == 2
    options = {"mode": "remote", "countries": ("Germany",), "days": 60, "floor": 50}
    survivors = {}
    for n in range(len(options) + 1):
        for chosen in itertools.combinations(options, n):
            survivors[frozenset(chosen)] = {r["row_id"] for r in kept(rows, Choices(**{k: options[k] for k in chosen})).select("row_id").collect()}
    assert all(survivors[b] <= survivors[a] for a in survivors for b in survivors if a < b)


def test_whole_filter_removes_copies_and_sorts(spark):
    from siftmill.plans.chains import Choices, accounting_with_copies, filtered

    rows = pool(spark).withColumn("url", F.concat(F.lit("http://a/jobs/"), F.col("row_id").cast("string")))
    again = rows.filter("row_id IN (0, 1)").withColumns({"row_id": F.col("row_id") + 20, "url": F.concat("url", F.lit("?from=mail"))})
    other = rows.filter("row_id = 0").withColumns({"row_id": F.lit(40), "url": F.lit("http://b/jobs/1"), "description": F.concat("description", F.lit(" Apply."))})
    every = rows.unionByName(again).unionByName(other).withColumn("score", F.when(F.col("row_id") == 1, 90).otherwise(F.col("score")))
    choices = Choices(countries=("Germany",), days=60, floor=50)
    counts = {r["reason"]: r["n"] for r in accounting_with_copies(every, choices).collect()}
    assert counts["copy"] == 4 and counts["kept"] == 3  # two addresses, and two texts of 5, 7 and 8
    # 0 and 40 are like postings: the longer one stays, and the scored one comes first
    out = [r["row_id"] for r in filtered(every, choices).collect()]
    assert set(out) <= {1, 40} and out and out[0] == (1 if 1 in out else 40)
    assert filtered(every.filter("row_id < 0"), choices).count() == 0


def test_clean_up_replaces_index_pages_by_their_links(spark):
    from siftmill.plans.chains import cleaned_up

    words = "Requirements, responsibilities and salary; apply now. "
    links = "".join(f'<a href="http://a/jobs/{k}">x</a>' for k in range(1, 9))
    data = [
        (1, "http://a/jobs/", links, "8 jobs", words, "2024-01-30"), (2, "http://a/jobs/1234", "", "One", words, "2024-01-30"), (3, "http://a/jobs/99999", "", "Old", words, "2023-01-30"),
        (4, "http://a/jobs/5678", "", "Gone", words + "This position has been filled", None), (5, "http://a/jobs/4321", "", "Thin", "menu", None), (6, "http://a/jobs/8", "", "Eight", words, None),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, title string, body string, posted string")
    known = spark.createDataFrame([("http://a/jobs/2",)], "url string")
    out = {r["url"]: r["found_on"] for r in cleaned_up(pages, known, "2024-02-01 00:00:00", 30, most_links=5).collect()}
    assert out == {"http://a/jobs/1234": None, "http://a/jobs/8": None, **{f"http://a/jobs/{k}": 1 for k in (1, 3, 4, 5, 6)}}


def test_screening_needs_a_real_quote(spark):
    from siftmill.plans.chains import module_reason, screened

    rows = pool(spark)
    verdicts = spark.createDataFrame([(0, True, "fully remote"), (1, True, "never said this"), (2, True, "abc"), (3, False, "cannot sponsor")], "row_id int, drop boolean, quote string")
    assert {r["row_id"] for r in screened(rows, verdicts).filter("screen_drop").collect()} == {0}
    assert {r["row_id"]: r["m"] for r in rows.select("row_id", module_reason("internship").alias("m")).collect()}[4] == "unpaid"


def test_stream_collects_in_batches(spark, tmp_path):
    from siftmill.streaming.ingest import arrivals, collect_into, first_of_each, without_time

    data = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", None), ("c", "2024-01-02 00:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    data.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = arrivals(spark, str(tmp_path / "in"), "k string, t timestamp", 1)
    for name, part in (("dated", first_of_each(stream, "k", "t")), ("undated", without_time(stream, "t"))):
        collect_into(part, str(tmp_path / name), str(tmp_path / f"{name}_state")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "dated")).collect()) == ["a", "c"]
    assert [r["k"] for r in spark.read.schema("k string, t timestamp").parquet(str(tmp_path / "undated")).collect()] == ["b"]


def test_registered_queries_have_stable_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_module_dedup_matches_brute_force(spark):
    from siftmill.functions.similarity import ratio, token_set
    from siftmill.operators.survivorship import module_dedup

    rng = random.Random(6)
    titles = ["Thesis on data in large and old systems", "thesis: data on large and old systems in", "Thesis Robotics", "Robotics thesis!", "", None]
    bodies = ["alpha beta gamma delta", "alpha beta gamma delta epsilon zeta", "one two three", "one two four five", None]
    data = [(k, rng.choice(titles), rng.choice(bodies), 1, rng.randint(0, 3), 1) for k in range(50)]
    key = lambda t: " ".join(sorted(w for w in __import__("re").split("[^a-z0-9]+", (t or "").lower()) if w))
    kept = []
    for row in sorted(data, key=lambda r: (-r[3], -r[4], -r[5], r[0])):

        def like(o, r=row):
            a, b = key(o[1]), key(r[1])
            if not (a and b and o[2] and r[2]) or ratio(a, b) < 90:
                return False
            return o[2] == r[2] or token_set(o[2], r[2]) >= (75 if min(len(a.split()), len(b.split())) >= 6 else 85)

        if not any(like(o) for o in kept):
            kept.append(row)
    df = spark.createDataFrame(data, "id int, title string, body string, q1 int, q2 int, q3 int")
    assert sorted(r["id"] for r in module_dedup(df).collect()) == sorted(r[0] for r in kept)
