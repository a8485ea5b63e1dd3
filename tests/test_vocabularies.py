"""Vocabularies in one pass, and languages by n-grams."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftmill.functions.vocabulary import folded
from siftmill.operators import languages as L
from siftmill.operators import vocabularies as W

SF = "/root/testdata/sf0.01"


def brute(text, term, whole):
    n = 0
    for spelling in {term, folded(term)}:
        end = r"(?![^\W])" if whole else ""
        n += len(re.findall(rf"(?<![^\W])(?={re.escape(spelling)}{end})", text))
    return n


@pytest.mark.parametrize("most", [W.AUTOMATON_CHARS, 40])
def test_term_hits_match_a_search_for_each_term(spark, most):
    rng = random.Random(7)
    bits = ["é", "e", "télé", "tele", "work", "home", " ", " ", "-", "_", "1", "ph", "d", "ß", ". "]
    texts = [(k, rng.choice(["en", "fr", "de", None, "xx"]), "".join(rng.choices(bits, k=40))) for k in range(60)] + [(60, "en", None), (61, "fr", "")]
    terms = sorted({(rng.choice(["a", "b"]), rng.choice(["en", "fr", "de"]), "".join(rng.choices(bits, k=rng.randrange(1, 4))), rng.random() < 0.5) for _ in range(80)})
    vocabulary = spark.createDataFrame([*terms, ("a", "en", "", False)], "section string, lang string, term string, whole boolean")
    got = {}
    for r in W.term_hits(spark.createDataFrame(texts, "id long, lang string, text string"), vocabulary, most).collect():
        key = (r["id"], r["section"], r["lang"], r["term"])
        got[key] = got.get(key, 0) + r["n"]
    want = {}
    for k, lang, text in texts:
        for section, of, term, whole in terms:
            if term and (lang not in ("en", "fr", "de") or of in (lang, "en")) and (n := brute(text or "", term, whole)):
                want[k, section, of, term] = want.get((k, section, of, term), 0) + n
    assert got == want


def test_a_text_is_read_once_however_many_terms_there_are():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = " ".join(word() for _ in range(100_000))
    took = []
    for n in (100, 20_000):
        found = W.automaton([(word() + " " + word(), True) for _ in range(n)])
        began = time.perf_counter()
        W.hits_of(text, found, None)
        took.append(time.perf_counter() - began)
    assert took[1] < 6 * took[0] + 0.2


def test_language_of_held_out_texts_and_of_short_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    detect = L.detector(L.profiles(docs.filter("doc_id % 5 <> 0")))
    held = docs.filter("doc_id % 5 = 0").select("lang", F.explode(L.windows(F.col("text"))).alias("piece")).filter("length(trim(piece)) >= 150")
    right = [r["lang"] == r["found"] for r in held.select("lang", detect("piece").alias("found")).collect()]
    assert len(right) > 1_000 and sum(right) >= 0.98 * len(right)
    odd = spark.createDataFrame([(None,), ("",), ("the and of the",), ("1 2 3 4 " * 20,), ("   " * 40 + "the",)], "t string")
    assert [r[0] for r in odd.select(detect("t")).collect()] == ["unknown"] * 5
    nothing = L.detector(L.profiles(docs.filter("false")))
    assert [r[0] for r in docs.limit(3).select(nothing("text")).collect()] == ["unknown"] * 3


def test_grams_and_windows_cover_the_whole_text(spark):
    assert [L.written(c) for c in L.gram_codes("Ab-c  1é").tolist()] == [" ab", "ab ", "b c", " c ", "c é", " é "]
    text = "".join(random.Random(3).choices("ab c", k=1_001))
    got = spark.createDataFrame([(text,), ("",)], "t string").select(L.windows(F.col("t"), 100).alias("w")).collect()
    assert "".join(got[0]["w"]) == text and [len(w) for w in got[0]["w"]] == [100] * 10 + [1] and got[1]["w"] == [""]
