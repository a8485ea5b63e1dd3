"""Language identification by a linear-chain conditional random field over words.

Words are described by their affixes, letter trigrams, themselves and lexicons of the languages' frequent words; learned transitions between languages let each
word count its neighbours in. The forward-backward algorithm gives every word of a text its probability of each
language, also where a text switches; a document gets the language with the largest share of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftmill.llm import crf
from siftmill.llm.common import free_name, held_out, table
from siftmill.llm.token_counts import pieces

#: Letters of a word; longer runs, as of scripts without spaces, are several words.
LONGEST = 32


WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: Words of a chain; longer texts are several chains, no word is left out.
CHAIN = 48
#: This share of the chains to learn from is spliced from two, so that a change of language is seen.
SPLICED = 0.25
UNKNOWN = "und"


def word_features(w: str, lexicon: dict[str, list[str]]) -> list[str]:
    """The word itself, the languages in whose lexicon it stands, its affixes and its letter trigrams."""
    framed = f"<{w}>"
    return ["w" + w, *lexicon.get(w, ()), *("p" + w[:k] for k in (1, 2, 3)), *("s" + w[-k:] for k in (1, 2, 3, 4)), *("t" + framed[i : i + 3] for i in range(len(framed) - 2))]


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a whole text, letters only; none if it has no letter."""
    words = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # numerals such as ½ count as parts of words for the pattern
    return [p for w in words for p in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass
class LanguageModel:
    languages: list[str]
    index: dict[str, int]
    chain: crf.Chain | None
    lexicon: dict[str, list[str]] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        get, ids, starts = self.index.get, [], []
        for w in words:
            starts.append(len(ids))
            ids.append(0)
            ids += [i for f in word_features(w, self.lexicon) if (i := get(f)) is not None]
        return crf.summed(self.chain.weights, np.array(ids), np.array(starts))


def lexicon_of(chains: list[list[str]], gold: list[list[int]], known: list[str], size: int = 1000) -> dict[str, list[str]]:
    """The most frequent words of each language, as features that name the languages."""
    out: dict[str, list[str]] = {}
    for k, lang in enumerate(known):
        seen = Counter(w for c, g in zip(chains, gold, strict=True) for w, y in zip(c, g, strict=True) if y == k)
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]:
            out.setdefault(w, []).append(f"in {lang}")
    return out


def fit(texts: list[str], languages: list[str], least_seen: int = 3, seed: int = 5) -> LanguageModel:
    """A model from whole labelled texts.

    Every word of a text carries the text's language. Some chains are spliced at random places from two, whose languages
    may differ: their words keep the language that they came with.
    """
    known = sorted(set(languages))
    chains, gold = [], []
    for text, lang in zip(texts, languages, strict=True):
        words = words_of(text)
        for k in range(0, len(words), CHAIN):
            chains.append(words[k : k + CHAIN])
            gold.append([known.index(lang)] * len(chains[-1]))
    if not chains:
        return LanguageModel(known, {}, None)
    rng = np.random.default_rng(seed)
    for k in np.flatnonzero(rng.random(len(chains)) < SPLICED).tolist():
        other = int(rng.integers(len(chains)))
        here, there = int(rng.integers(len(chains[k]) + 1)), int(rng.integers(len(chains[other]) + 1))
        if here + len(chains[other]) - there:
            chains[k], gold[k] = chains[k][:here] + chains[other][there:], gold[k][:here] + gold[other][there:]
    lexicon = lexicon_of(chains, gold, known)
    by_word = {w: word_features(w, lexicon) for w in set().union(*chains)}
    seen = Counter(f for c in chains for w in c for f in by_word[w])
    index = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least_seen))}
    ids_of = {w: [0, *(index[f] for f in fs if f in index)] for w, fs in by_word.items()}
    per_item = [ids_of[w] for c in chains for w in c]
    lengths = np.array([len(c) for c in chains])
    sizes = np.array([len(x) for x in per_item])
    ids = np.fromiter((i for x in per_item for i in x), dtype=np.int64, count=int(sizes.sum()))
    learned = crf.fit(ids, np.r_[0, np.cumsum(sizes)[:-1]], np.array([y for g in gold for y in g]), lengths, len(index) + 1, len(known), epochs=4)
    return LanguageModel(known, index, learned, lexicon)


class Recogniser:
    """Scores texts by a model, remembering the emissions of words."""

    def __init__(self, model: LanguageModel, remembered: int = 300_000):
        self.model, self.remembered = model, remembered
        self.place: dict[str, int] = {}
        self.table = np.zeros((remembered, len(model.languages)), dtype=np.float32)

    def predict(self, texts: list[str | None], at_once: int = 60_000) -> list[tuple[str, float]]:
        """The language with the largest share of a text's words, and that share; of equal shares the first by name."""
        if self.model.chain is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        sums, words = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), dtype=np.int64)
        pending: list[list[str]] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                pending.append(words_of(piece))
                owners.append(k)
                size += len(pending[-1])
                if size >= at_once:
                    self._add(pending, owners, sums, words)
                    pending, owners, size = [], [], 0
        self._add(pending, owners, sums, words)
        share = sums / np.maximum(words, 1)[:, None]
        best = share.argmax(axis=1)
        return [(self.model.languages[k], min(1.0, float(s[k]))) if n else (UNKNOWN, 0.0) for k, s, n in zip(best, share, words, strict=True)]

    def _add(self, found: list[list[str]], owners: list[int], sums: np.ndarray, words: np.ndarray) -> None:
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        total = int(lengths.sum())
        if not total:
            return
        new = sorted(set().union(*found) - self.place.keys())
        if len(self.place) + len(new) > self.remembered:
            self.place.clear()
            new = sorted(set().union(*found))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), len(self.model.languages)), dtype=np.float32)
        if new:
            at = len(self.place)
            self.table[at : at + len(new)] = self.model.emissions(new)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
        rows = np.fromiter(map(self.place.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=total)
        # whole chains and a last one of what is left, for each piece
        whole, rest = lengths // CHAIN, lengths % CHAIN
        n_chains = whole + (rest > 0)
        chains = np.full(int(n_chains.sum()), CHAIN, dtype=np.int64)
        chains[(np.cumsum(n_chains) - 1)[rest > 0]] = rest[rest > 0]
        gamma = crf.forward_backward(self.model.chain, self.table[rows], chains)
        owner = np.repeat(np.array(owners), lengths)
        np.add.at(words, np.array(owners), lengths)
        for k in range(gamma.shape[1]):
            sums[:, k] += np.bincount(owner, gamma[:, k], len(sums))


def learn(docs: DataFrame, sample: int = 1_000, longest: int = 50_000) -> LanguageModel:
    """A model from at most ``sample`` documents of a known language outside the held-out fold, the first by a hash.

    Texts of over ``longest`` characters are not taken to learn from, so that what comes to the driver is bounded; an id
    that occurs repeatedly teaches once.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out()).filter(F.length("text") <= longest)
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    once = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("r"))
    taught = once.select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    return fit(taught["text"].tolist(), taught["lang"].tolist())


def recognised(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; null texts and texts without a letter are ``und`` with a score of 0.

    Columns of these two names are replaced, all others are carried. Repeated rows are each read; no rows give no rows.
    """

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        recogniser = Recogniser(model)
        for texts in batches:
            yield pd.DataFrame(recogniser.predict(texts.where(texts.notna(), None).tolist()), columns=["lang_pred", "score"])

    found = free_name(docs, "found")
    return docs.withColumn(found, predict(F.col(text_col))).withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}).drop(found)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = recognised(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
