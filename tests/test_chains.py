"""The whole filter with twins, and the module searches, against walks row by row."""

import random
import re

from pyspark.sql import functions as F

from siftmill.functions.similarity import ratio, token_set
from siftmill.operators.ordering import placed, placed_within
from siftmill.plans.chains import Choices, accounted, filtered, kept, module_reason, module_search

COLUMNS = "row_id int, title string, description string, country string, url string, company string, lang string, thin boolean, workplace string, sponsorship string, posted_raw string, score int"


def offers(seed, n=120):
    rng = random.Random(seed)
    words = "cloud data pipeline warehouse team berlin build sql python spark index query lake table stream batch join".split()
    bodies = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    titles = ["data engineer", "senior data engineer", "data engineer platform", "nurse", "analyst of data", ""]
    out = []
    for k in range(n):
        body = rng.choice(bodies) + rng.choice(["", " sql", " more words here", " volunteer position unpaid"])
        out.append((k, rng.choice(titles), body, rng.choice(["Germany", "Germany", "France", None]), f"https://{rng.choice(['a.com', 'b.com', 'c.org'])}/jobs/{k}", rng.choice(["Acme GmbH", "Beta Ltd.", ""]), "en", False, None, "", "2024-01-20", rng.choice([None, 10, 80])))
    return out


def test_every_posting_is_accounted_for(spark):
    data = offers(3)
    rows, choices = spark.createDataFrame(data, COLUMNS), Choices(countries=("Germany",), days=60)
    reasons = {r["row_id"]: r["reason"] for r in accounted(rows, choices).collect()}
    assert len(reasons) == len(data)
    # a walk over what the rules keep
    best = {}
    for r in sorted(data, key=lambda r: (-len(r[2]), r[0])):
        best.setdefault(re.sub(r"\s+", " ", r[2].lower()).strip(), r)
    ruled = {r["row_id"] for r in kept(rows, choices).collect()}
    left = [r for r in best.values() if r[0] in ruled]
    key = lambda t: re.sub(r"[^a-z ]+", " ", t.lower()).strip()
    one = []
    for r in sorted(left, key=lambda r: (-len(r[2]), -(r[5] != ""), r[0])):
        if not (key(r[1]) and any(key(o[1]) and ratio(key(o[1]), key(r[1])) >= 90 and token_set(o[2], r[2]) >= 80 for o in one)):
            one.append(r)
    last = []
    for r in sorted(one, key=lambda r: (-len(r[2]), r[0])):
        twin = lambda o, r=r: r[5] and o[5] == r[5] and r[1] and o[1] and token_set(o[1], r[1]) >= 90 and o[4].split("/")[2] != r[4].split("/")[2] and (not o[3] or not r[3] or o[3] == r[3])
        if not any(twin(o) for o in last):
            last.append(r)
    assert {k for k, x in reasons.items() if x in ("kept", "twin")} == {r[0] for r in one}
    assert {k for k, x in reasons.items() if x == "kept"} == {r[0] for r in last}
    assert {r["row_id"] for r in filtered(rows, choices, twins=True).collect()} == {r[0] for r in last}
    assert {"copy", "place", "unpaid", "kept"} <= set(reasons.values())
    assert accounted(rows.filter("row_id < 0"), choices).count() == 0


def test_module_search_is_one_chain(spark):
    data = [(k, t, d, "Germany", f"u{k}", "Acme", "en", False, None, "", "", None) for k, (t, d) in enumerate([
        ("Internship data", "the team and the data of the week is for you in the lake " * 3), ("data internship", "the team and the data of the week is for you in the lake " * 3 + "now"),
        ("Data engineer", "the work"), ("PhD student", "with an internship before"), ("Internship law", "the law and the court of the land " * 4), ("Internship x", "unpaid and for the good of it"),
    ])]
    rows = spark.createDataFrame(data, COLUMNS)
    verdicts = spark.createDataFrame([(4, True, "the court of the land"), (1, True, "never said at all"), (0, True, "the team and")], "row_id int, drop boolean, quote string")
    got = {r["row_id"]: r["reason"] for r in module_search(rows, "internship", verdicts).collect()}
    assert got == {0: "like", 1: "kept", 2: "no internship", 3: "phd", 4: "reviewer", 5: "unpaid"}
    assert {r["row_id"] for r in rows.filter(module_reason("internship").isNull()).collect()} == {0, 1, 4}


def test_places_with_outliers_ties_and_nulls(spark):
    rng = random.Random(4)
    data = [(k, rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, 1.0, 2.0, None, 1e300, -5.0])) for k in range(400)]
    df = spark.createDataFrame(data, "id int, k string, x double")
    got = {r["id"]: r["place"] for r in placed_within(df, ["k"], "x", "id").collect()}
    for key in ("a", "b", None):
        order = sorted((r for r in data if r[1] == key), key=lambda r: (r[2] is None, r[2] or 0.0, r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    whole = {r["id"]: r["place"] for r in placed(df, [F.desc_nulls_last("x"), "id"], ranges=7).collect()}
    order = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
    assert [whole[r[0]] for r in order] == list(range(1, 401))
