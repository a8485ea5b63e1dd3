"""Phrase mining against counting every phrase, with portions and groups small enough to be cut everywhere."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmill.llm.collocations import collocations, parts, phrase_counts

WORDS = "the a of oak elm fir in new york red wine Bench é ß the a of the".split()


def texts(seed, n=60):
    rng = random.Random(seed)
    out = [None, "", " \t", "...", "One", "one\ttwo three . two\x0bthree", "x" * 500, " ".join(["the"] * 200), "and so on " * 90]
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rng.randrange(1, 80))))
    return [*out, " ".join(rng.choice(WORDS) for _ in range(3_000))]


def brute(rows, least, covered, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        count = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, 5):
                count.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, count in f.items():
        found = []
        phrases = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in phrases.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("budget", "portion"), [(1_000_000, 8 << 20), (60, 300), (8, 2_000)])
def test_collocations_match_counting(spark, budget, portion):
    rows = [(t, lang) for k, t in enumerate(texts(3)) for lang in (["en"] if k % 3 else [None, "de"])]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    assert got(collocations(docs, least=5, most=40, budget=budget, portion=portion)) == brute(rows, 5, 80, 40)


def test_nodes_are_all_frequent_phrases(spark):
    rows = [(t, "en") for t in texts(8)]
    nodes, langs = phrase_counts(spark.createDataFrame(rows, "text string, lang string").filter("text IS NOT NULL"), 4, budget=15, portion=500)
    lower, count = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for text, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            count.update(" ".join(ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    assert {r["phrase"]: r["f"] for r in nodes.collect()} == {p: n for p, n in count.items() if n >= 4}
    assert langs.first()["n"] == sum(n for p, n in count.items() if " " not in p)


def test_parts_cut_a_text_without_losing_a_phrase():
    rng = random.Random(1)
    text = " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(9)) for _ in range(800))
    found = list(parts(text, 100))
    assert len(found) > 20 and all(cut for _, cut in found[:-1])
    starts = Counter()
    for data, cut in found:
        ws = data.decode().split()
        starts.update(" ".join(ws[i : i + 4]) for i in range(len(ws) - (3 if cut else 0)))
    ws = text.split()
    assert starts == Counter(" ".join(ws[i : i + 4]) for i in range(len(ws)))
    assert b"".join(d for d, _ in parts("y" * 5_000, 100)) == b"y" * 5_000  # a word is never cut


def test_collocations_of_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")
    assert collocations(docs).count() == 0
    assert collocations(docs.filter("lang = 'xx'")).count() == 0
