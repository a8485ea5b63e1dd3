"""Vocabularies of any size: all terms of all sections found in one pass over each text.

A vocabulary is a table of terms by section and language. It is put into an Aho-Corasick automaton, which reads a text
once however many terms there are; borders of words are kept, and a term is also found spelled without its accents. A
vocabulary too large for one automaton is several, each of a bounded number of characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.vocabulary import TERMS, folded
from siftmill.tables import stored

#: Characters of an automaton's terms, each of which takes a node of some tens of bytes in every task.
AUTOMATON_CHARS = 4 << 20
#: Different pairs of words after which a task hands on what it has added up.
HELD_PAIRS = 1 << 18
#: Terms of up to so many letters must end with a word as they begin with one.
SHORT = 3


def own_terms(spark) -> DataFrame:
    """The library's own terms as a table: section, lang, term, whole."""
    rows = [(s, lang, t, len(t) <= SHORT) for s, by_lang in TERMS.items() for lang, ts in by_lang.items() for t in ts]
    return spark.createDataFrame(rows, "section string, lang string, term string, whole boolean")


def learned_terms(docs: DataFrame, per_language: int, section: str = "frequent") -> DataFrame:
    """The most frequent pairs of neighbouring words of each language as terms of whole words.

    docs has lang and text; words are runs of letters and digits in lower case, pairs do not reach over other characters
    than single spaces. Ties go by the pair's own order; each task hands on no more than a language's share of its pairs, unsorted.
    """
    texts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.lower("text").alias("text"))
    counts = texts.mapInArrow(_pairs, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("term")]
    first = counts.mapInArrow(_most(per_language), "lang string, term string, n long")
    chosen = first.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= per_language)
    return chosen.select(F.lit(section).alias("section"), "lang", "term", F.lit(True).alias("whole"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of neighbouring words stands in texts, by language; pairs are added up within a task first."""
    seen: dict[str, Counter[str]] = {}

    def told() -> pa.RecordBatch:
        langs, terms, counts = ([], [], [])
        for lang, pairs in seen.items():
            langs += [lang] * len(pairs)
            terms += pairs.keys()
            counts += pairs.values()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            words, pairs = text.as_py().split(" "), seen.setdefault(lang, Counter())
            for start in range(0, len(words), HELD_PAIRS):
                part = words[start : start + HELD_PAIRS + 1]
                whole = {w for w in set(part) if w.replace("_", "0").isalnum()}
                pairs.update([f"{a} {b}" for a, b in pairwise(part) if a in whole and b in whole])
                if sum(map(len, seen.values())) > HELD_PAIRS:
                    yield told()
                    pairs = seen.setdefault(lang, Counter())
    yield told()


def _most(per_language: int):
    """Of a task's pairs the most frequent of each language; no more than some times as many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, str]]] = {}
        least: dict[str, int] = {}
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.and_(pc.equal(batch.column("lang"), lang), pc.greater_equal(batch.column("n"), least.get(lang, 0))))
                pairs = held.setdefault(lang, [])
                pairs += [(-n, term) for n, term in zip(own.column("n").to_pylist(), own.column("term").to_pylist(), strict=True)]
                if len(pairs) > 2 * per_language:
                    held[lang] = sorted(pairs)[:per_language]
                    least[lang] = -held[lang][-1][0]
        for lang, pairs in held.items():
            most = sorted(pairs)[:per_language]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(most), pa.string()), pa.array([t for _, t in most], pa.string()), pa.array([-n for n, _ in most], pa.int64())], names=["lang", "term", "n"])

    return run


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def automaton(terms: list[tuple[str, bool]]) -> ahocorasick.Automaton:
    """Spellings with the numbers of their terms, and whether they must end with a word."""
    owners: dict[str, list[tuple[int, bool]]] = {}
    for k, (term, whole) in enumerate(terms):
        for spelling in {term, folded(term)}:
            owners.setdefault(spelling, []).append((k, whole))
    found = ahocorasick.Automaton()
    for spelling, who in owners.items():
        found.add_word(spelling, (len(spelling), who))
    found.make_automaton()
    return found


def hits_of(text: str, found: ahocorasick.Automaton, may: set[int] | None) -> dict[int, int]:
    """How often each term begins with a word, and ends with one where it must; hits may overlap."""
    seen: dict[int, int] = {}
    for last, (size, who) in found.iter(text):
        first = last - size + 1
        if first and is_word(text[first - 1]):
            continue
        ends = last + 1 == len(text) or not is_word(text[last + 1])
        for k, whole in who:
            if (ends or not whole) and (may is None or k in may):
                seen[k] = seen.get(k, 0) + 1
    return seen


def shares(vocabulary: DataFrame, most: int) -> list[list[tuple[int, str, str, bool]]]:
    """The terms in shares of at most so many characters or a single term; each comes to the driver by itself."""
    sized = vocabulary.withColumn("share", F.pmod(F.xxhash64("number"), F.lit(max(1, -(-2 * (vocabulary.agg(F.sum(F.length("term"))).first()[0] or 0) // most)))))
    numbers = [r["share"] for r in sized.select("share").distinct().orderBy("share").collect()]
    return ((lambda rows: [(r["number"], r["lang"], r["term"], r["whole"]) for r in rows])(sized.filter(F.col("share") == k).orderBy("number").collect()) for k in numbers)


def term_hits(texts: DataFrame, vocabulary: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """How often each text holds each term that applies to it: id, section, lang, term, n.

    ``texts`` has id, lang and text, in lower case; ``vocabulary`` section, lang, term in lower case, and whole. A text is
    read in the terms of its language and of English; one without a language, or of one that has no terms, in all of
    them. Null texts and empty terms hold and are nothing. Every text is read once for each automaton.
    """
    terms = vocabulary.filter("term <> ''").distinct()
    terms = stored(terms.withColumn("number", F.monotonically_increasing_id()), "terms")
    known = {r["lang"] for r in terms.select("lang").distinct().collect()}
    kind = dict(texts.dtypes)["id"]
    parts = []
    for share in shares(terms, most):
        parts.append(texts.select("id", "lang", "text").mapInArrow(_reader(share, known), f"id {kind}, number long, n long"))
    if not parts:
        return texts.select("id", F.lit("").alias("section"), "lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits.join(terms, "number").select("id", "section", "lang", "term", "n")


def _reader(share: list[tuple[int, str, str, bool]], known: set[str]):
    numbers = [s[0] for s in share]
    by_language: dict[str, set[int]] = {}
    for k, (_, lang, _, _) in enumerate(share):
        by_language.setdefault(lang, set()).add(k)
    may = {lang: by_language.get(lang, set()) | by_language.get("en", set()) for lang in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton([(term, whole) for _, _, term, whole in share])
        for batch in batches:
            rows, which, counts = [], [], []
            for k, (text, lang) in enumerate(zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True)):
                for number, n in hits_of(text.as_py() or "", found, may.get(lang)).items():
                    rows.append(k)
                    which.append(numbers[number])
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(which, pa.int64()), pa.array(counts, pa.int64())], names=["id", "number", "n"])

    return run


def sections_hit(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id and the sorted sections of which a text holds a term; texts without any hit are not among them."""
    return term_hits(texts, vocabulary).groupBy("id").agg(F.sort_array(F.collect_set("section")).alias("sections"))
