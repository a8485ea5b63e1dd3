"""Token counts of a BPE vocabulary with word ends, by rank-synchronous array merging.

The texts of a batch are one array of code points; classes of characters, looked up in a table, give the borders of the
pre-tokens, which are its ragged slices. Slices are told apart by a 64-bit hash. Those not met before are merged: in each
round every sequence of symbols finds its lowest-ranked adjacent pair and merges all places where that pair stands, all
sequences at once; sequences without a known pair are done, and what is left of them is counted. The vocabulary's own
pre-processing is followed: special strings are taken out first, then NFC, lower case, and the split into letters, single
digits and other characters.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftmill.llm.common import table

VOCABULARY = "word_bpe_49k.json"
NONE = np.int64(1) << 40
#: Fixed values of the vocabulary's format: what an apostrophe takes with it, and white space.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts are taken in pieces of about so many characters, longer ones cut before white space.
PIECE = 250_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one above 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    for pattern, kind in ((rf"[{SPACE}]", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        out[code_points("".join(regex.findall(pattern, every)))] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut before ASCII white space where it passes the size; such a cut changes no pre-token."""
    start = 0
    while len(text) - start > size:
        found = re.compile("[ \t\n\r]").search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class WordBpe:
    """Counts tokens as the tokenizer in the file would, without added special tokens, truncation or padding."""

    def __init__(self, path: str, remembered: int = 20):
        """``remembered``: the binary logarithm of the number of pre-tokens whose counts are remembered."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.mark = re.compile("|".join({re.escape(s[:2]) for s in special}))
        self.classes = class_table()
        self.white = "".join(map(chr, np.flatnonzero(self.classes == _SPACE)))
        self.draw = np.random.default_rng(977)
        self.factors = np.zeros(0, dtype=np.uint64)
        # one entry for each slot: a later pre-token of the same slot takes it over
        self.shift = np.uint64(64 - remembered)
        self.known = np.zeros(1 << remembered, dtype=np.uint64)
        self.counts = np.zeros(1 << remembered, dtype=np.int64)

    def merged(self, words: list[str]) -> np.ndarray:
        """The number of symbols left of each word when no known pair remains."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        bytes_ = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[bytes_]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[bytes_[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.zeros(len(words), dtype=np.int64)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            pair = (symbols << 20) | np.r_[symbols[1:], 0]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            inside = np.r_[owner[1:] == owner[:-1], False]
            rank = np.where(inside & (self.keys[at] == pair), self.ranks[at], NONE)
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = lowest == NONE
            left[owner[starts[done]]] = lengths[done]
            chosen = rank == np.repeat(np.where(done, -1, lowest), lengths)
            # of overlapping places, as in "aaa", every second one counts from the left
            opens = chosen & ~np.r_[False, chosen[:-1]]
            place = np.arange(len(symbols))
            since = place - np.maximum.accumulate(np.where(opens, place, 0))
            chosen &= since % 2 == 0
            symbols = np.where(chosen, self.made[np.where(chosen, rank, 0)], symbols)
            stays = np.repeat(~done, lengths)
            stays[1:] &= ~chosen[:-1]
            symbols, owner = symbols[stays], owner[stays]
        return left

    def hashes(self, codes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of each slice without the white space at its end: a sum of its characters times factors by their place."""
        lengths = np.diff(np.r_[starts, len(codes)])
        longest = int(lengths.max())
        if longest > len(self.factors):
            self.factors = np.r_[self.factors, self.draw.integers(0, 1 << 63, 2 * longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        value = (codes.astype(np.uint64) + np.uint64(1)) * self.factors[place]
        value[classes == _SPACE] = 0
        h = np.add.reduceat(value, starts)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return np.maximum(h ^ (h >> np.uint64(29)), np.uint64(1))

    def borders(self, codes: np.ndarray, classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: a class begins, a number stands, or an apostrophe that no other character precedes
        has taken its short form. ``firsts`` are the places where texts begin."""
        before = np.r_[np.uint8(_SPACE), classes[:-1]]
        before[firsts] = _SPACE
        start = (classes != _SPACE) & ((classes != before) | (classes == _NUMBER))
        quotes = np.flatnonzero((codes == ord("'")) & start)
        if len(quotes):
            inside = np.full(len(codes) + 3, 0, dtype=np.uint32)
            inside[: len(codes)] = codes
            last = np.full(len(codes) + 3, True)  # no short form reaches into another text
            last[: len(codes)] = False
            last[firsts] = True
            taken = np.zeros(len(quotes), dtype=np.int64)
            for form in SHORT_FORMS:
                fits = taken == 0
                for k, c in enumerate(form, 1):
                    fits &= (inside[quotes + k] == ord(c)) & ~last[quotes + k]
                taken[fits] = len(form)
            quotes, taken = quotes[taken > 0], taken[taken > 0]
            start[quotes + 1] = False
            after = quotes + taken + 1
            after = after[after < len(codes)]
            start[after] |= classes[after] != _SPACE
        return np.flatnonzero(start)

    def count_pieces(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, lower case and without special strings."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(len(texts), dtype=np.int64)
        codes = code_points(whole)
        classes = self.classes[codes]
        begins = np.cumsum(lengths) - lengths
        starts = self.borders(codes, classes, begins[lengths > 0])
        if not len(starts):
            return np.zeros(len(texts), dtype=np.int64)
        # what stands before the first start is white space
        codes, classes, offset = codes[starts[0] :], classes[starts[0] :], starts[0]
        h = self.hashes(codes, classes, starts - offset)
        slot = h >> self.shift
        counts = self.counts[slot]
        new = np.flatnonzero(self.known[slot] != h)
        if len(new):
            number, distinct = pd.factorize(h[new])
            at = new[np.unique(number, return_index=True)[1]]
            ends = np.r_[starts[1:], len(whole)][at]
            words = [whole[s:e] for s, e in zip(starts[at].tolist(), ends.tolist(), strict=True)]
            found = self.merged([w.rstrip(self.white) for w in words])
            counts[new] = found[number]
            slots = distinct >> self.shift
            self.known[slots], self.counts[slots] = distinct, found
        owner = np.searchsorted(begins + lengths, starts, side="right")
        return np.bincount(owner, counts, len(texts)).astype(np.int64)

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        found = np.zeros(len(texts), dtype=np.int64)
        held, owners, size = [], [], 0

        def counted() -> None:
            np.add.at(found, np.array(owners, dtype=np.int64), self.count_pieces(held))

        for k, text in enumerate(texts):
            parts = [text]
            if self.mark.search(text):
                parts = self.special.split(text)
                found[k] += len(parts) - 1
            for part in parts:
                for piece in pieces(part):
                    held.append(piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
                    owners.append(k)
                    size += len(piece)
                    if size >= PIECE:
                        counted()
                        held, owners, size = [], [], 0
        if held:
            counted()
        return found.tolist()


def token_counter(vocabulary: str):
    """A column function: tokens of a text column under the vocabulary file at that path; null counts as empty."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(vocabulary)
        for texts in batches:
            yield pd.Series(bpe.count_texts(texts.where(texts.notna(), "").tolist()), dtype="int64")

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. Other columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_counter(vocabulary)(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
