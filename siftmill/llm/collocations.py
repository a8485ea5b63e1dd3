"""Phrases whose words stand together more often than their parts, from depth-truncated suffix trees.

The suffix tree of all pieces, four words deep, is built by vertical partitioning. A first scan counts the word prefixes
by hash cells; prefixes are grouped until a group's suffixes fill the memory budget, and a prefix that alone exceeds it
is extended by its second word, and by all of them where that pair still does. A second scan sends every suffix to the
group of its prefix. Each group sorts its suffixes and builds its subtrees by itself, from where neighbours part, and
reads each node's count from its leaves' totals. Only the nodes along a prefix that was split over groups are added up
between them.

Cells also tell which words and pairs can reach the least count: a suffix ends where the rest of it cannot. Cells are
sums over what falls into them, so no phrase is lost by them, and their number is fixed: a few MB come to the driver,
whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.common import join_groups, stored, table
from siftmill.llm.near_dedup import mix

#: Words of the longest phrase.
DEPTH = 4
#: Cells of words and of pairs, as powers of two; 64 cells of words that follow each other are a class of prefixes.
WORD_BITS, PAIR_BITS, CLASS_BITS = 22, 27, 16
BLOCK = 1 << 16
STOP = b"."
#: Counts that a task holds and adds up before it sends them.
HELD = 2_000_000
#: Parts in which a task adds up its suffixes, one after another.
PARTS = 8
#: A-Z is lower-cased, [.,;:!?\x0A-\x0D] end a piece, words are runs without space and tab.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + STOP * 9)
UNKNOWN = "und"


def parts(text: str | None, most: int) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about so many bytes, cut at ends of pieces; a part that had to be cut inside a piece is marked,
    and its last words, as many as may begin a phrase that ends after it, are the next part's first again."""
    data = (text or "").encode("utf-8").translate(_TABLE)
    start, reach = 0, most
    while len(data) - start > reach:
        cut = data.rfind(STOP, start, start + reach)
        if cut > start:
            yield data[start:cut], False
            start, reach = cut + 1, most
            continue
        cut = data.rfind(b" ", start, start + reach)
        words = data[start : max(cut, start)].rsplit(None, DEPTH - 1)
        if len(words) < DEPTH:
            reach *= 2
            continue
        yield data[start:cut], True
        start, reach = start + len(words[0]), most
    yield data[start:], False


@dataclass
class Words:
    """The words of a portion of the corpus, one after another, with a STOP between pieces."""

    known: np.ndarray  # the distinct words
    code: np.ndarray  # which of them each is
    lang: np.ndarray  # which language each is of
    langs: list[str]
    run: np.ndarray  # the words from here to the end of the piece, up to DEPTH
    start: np.ndarray  # phrases are counted from here
    hashed: np.ndarray  # of language and word
    pair: np.ndarray  # of language, word and the next word


def words_of(pieces: list[tuple[bytes, bool]], owner: list[str]) -> Words:
    flat: list[bytes] = []
    sizes, again = [], []
    for data, cut in pieces:
        before = len(flat)
        flat += data.replace(STOP, b" . ").split()
        if cut:
            again += range(len(flat) - DEPTH + 1, len(flat))
        flat.append(STOP)
        sizes.append(len(flat) - before)
    words = np.empty(len(flat), dtype=object)
    words[:] = flat
    del flat
    code, known = pd.factorize(words)
    del words
    langs = sorted(set(owner))
    at = {x: k for k, x in enumerate(langs)}
    lang = np.repeat(np.array([at[x] for x in owner], dtype=np.int64), sizes)
    word = pd.util.hash_array(known, categorize=False)
    salt = mix(pd.util.hash_array(np.array(langs, dtype=object), categorize=False))
    stops = np.flatnonzero(code == code[-1])
    run = stops[np.searchsorted(stops, np.arange(len(code)))] - np.arange(len(code))
    start = run > 0
    start[again] = False
    hashed = mix(word[code] + salt[lang])
    following = np.r_[word[code[1:]], np.zeros(1, dtype=np.uint64)]
    return Words(known, code, lang, langs, np.minimum(run, DEPTH), start, hashed, mix(hashed * np.uint64(0x9E3779B97F4A7C15) + following, 5))


def portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Words]:
    """The words of all texts, in portions of about so many bytes."""
    pieces: list[tuple[bytes, bool]] = []
    owner: list[str] = []
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            for part in parts(text.as_py(), most):
                pieces.append(part)
                owner.append(lang)
                size += len(part[0]) + 1
                if size >= most:
                    yield words_of(pieces, owner)
                    pieces, owner, size = [], [], 0
    if pieces:
        yield words_of(pieces, owner)


def merged_counts(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of cells put together, by cell."""
    cell, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
    return cell[first], np.add.reduceat(n, first) if len(first) else n


def cell_counts(docs: DataFrame, portion: int) -> DataFrame:
    """Counts of words and pairs by cells, as rows of a block of cells each, and of words by language."""
    schema = "kind int, block int, places binary, counts binary, lang string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0
        for w in portions(batches, portion):
            counted = w.start
            for kind, cells in enumerate((w.hashed[counted] >> np.uint64(64 - WORD_BITS), w.pair[counted & (w.run > 1)] >> np.uint64(64 - PAIR_BITS))):
                cell, n = np.unique(cells, return_counts=True)
                held[kind].append((cell.astype(np.uint32), n.astype(np.uint32)))
                size += len(cell)
            yield packed([], w)
            if size > HELD:
                for kind in (0, 1):
                    yield packed([(kind, *merged_counts(held[kind]))])
                    held[kind].clear()
                size = 0
        for kind in (0, 1):
            if held[kind]:
                yield packed([(kind, *merged_counts(held[kind]))])

    def packed(counts: list[tuple[int, np.ndarray, np.ndarray]], w: Words | None = None) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], [], []]
        for kind, cell, n in counts:
            block = cell // BLOCK
            ends = np.r_[np.flatnonzero(np.diff(block)) + 1, len(cell)] if len(cell) else []
            begin = 0
            for end in ends:
                row = (kind, int(block[begin]), (cell[begin:end] % BLOCK).astype(np.uint16).tobytes(), n[begin:end].astype(np.uint32).tobytes(), None, 0)
                begin = end
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
        if w is not None:
            for lang, n in zip(w.langs, np.bincount(w.lang[w.start], minlength=len(w.langs)).tolist(), strict=True):
                for column, value in zip(rows, (2, 0, b"", b"", lang, n), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["kind", "block", "places", "counts", "lang", "n"])

    return docs.select("text", "lang").mapInArrow(run, schema)


def summed_cells(cells: DataFrame, least: int, budget: int) -> DataFrame:
    """For each block of cells: a bit for every cell that reaches ``least``, the cells over the budget, and the totals of
    the classes in it."""
    schema = "kind int, block int, bits binary, over array<int>, classes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(BLOCK, dtype=np.int64)

        def done() -> pa.RecordBatch:
            classes = total.reshape(BLOCK >> (WORD_BITS - CLASS_BITS), -1).sum(axis=1).tolist() if key[0] == 0 else []
            row = [[key[0]], [key[1]], [np.packbits(total >= least, bitorder="little").tobytes()], [np.flatnonzero(total > budget).tolist()], [classes]]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["kind", "block", "bits", "over", "classes"])

        for batch in batches:
            for kind, block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "places", "counts")), strict=True):
                if key != (kind, block):
                    if key:
                        yield done()
                    key = (kind, block)
                    total[:] = 0
                total[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
        if key:
            yield done()

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.filter("kind < 2").select("kind", "block", "places", "counts")
    return rows.repartition(tasks, "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(run, schema)


@dataclass
class Plan:
    """Which words and pairs may be frequent, and the groups of the prefixes."""

    words: np.ndarray
    pairs: np.ndarray
    hot_pairs: np.ndarray
    home: np.ndarray  # the group of a class, or the first of those of a class that was extended
    split: np.ndarray  # the groups of an extended class, 0 for all others
    groups: int

    @classmethod
    def of(cls, blocks: pa.Table, budget: int) -> Plan:
        bits = [np.zeros(1 << (b - 3), dtype=np.uint8) for b in (WORD_BITS, PAIR_BITS)]
        total = np.zeros(1 << CLASS_BITS, dtype=np.int64)
        hot: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        for row in blocks.to_pylist():
            bits[row["kind"]][row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], dtype=np.uint8)
            if row["kind"]:
                hot.append(np.array(row["over"], dtype=np.int64) + row["block"] * BLOCK)
            else:
                at = row["block"] * len(row["classes"])
                total[at : at + len(row["classes"])] = row["classes"]
        large = total > budget
        home = (np.cumsum(np.where(large, 0, total)) - np.where(large, 0, total)) // budget
        plain = int(home.max(initial=0)) + 1
        split = np.where(large, -(-total // budget), 0)
        home[large] = plain + (np.cumsum(split) - split)[large]
        return cls(*bits, np.sort(np.concatenate(hot)), home, split, plain + int(split.sum()))

    def marked(self, bits: np.ndarray, hashed: np.ndarray, power: int) -> np.ndarray:
        cell = (hashed >> np.uint64(64 - power)).astype(np.int64)
        return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    def placed(self, hashed: np.ndarray, pair: np.ndarray, whole: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of suffixes, by the hashes of their first word, their first two and all, and the words of the
        prefixes that the groups are made of; ``long`` are those of two words or more."""
        kind = (hashed >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        cell = (pair >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        found = np.searchsorted(self.hot_pairs, cell)
        hot = long & (self.hot_pairs[np.minimum(found, len(self.hot_pairs) - 1)] == cell) if len(self.hot_pairs) else np.zeros(len(cell), dtype=bool)
        split = self.split[kind]
        by = np.where(hot, whole, np.where(long, pair, hashed))
        group = self.home[kind] + np.where(split, (mix(by, 11) % np.maximum(split, 1).astype(np.uint64)).astype(np.int64), 0)
        return group, np.where(split == 0, 1, np.where(hot, DEPTH, 2))


def ragged_suffixes(w: Words, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Positions of one of each different suffix, how often it occurs in the portion, and its words.

    A suffix ends where its next word or pair can reach the least count no more.
    """
    word = plan.marked(plan.words, w.hashed, WORD_BITS) & (w.run > 0)
    pair = np.zeros(len(word) + DEPTH, dtype=bool)
    pair[: len(word) - 1] = (w.run[:-1] > 1) & word[:-1] & word[1:] & plan.marked(plan.pairs, w.pair[:-1], PAIR_BITS)
    length = word.astype(np.int64)
    open_ = word.copy()
    for k in range(DEPTH - 1):
        open_ &= pair[k : k + len(word)]
        length += open_
    size = len(w.known)
    for long in range(1, DEPTH + 1):
        at = np.flatnonzero(w.start & (length == long))
        if not len(at):
            continue
        key = w.lang[at] * size + w.code[at]
        for k in range(1, long):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + w.code[at + k]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        yield at[first], n, long


def suffixes(docs: DataFrame, plan: Plan, portion: int) -> DataFrame:
    """Different suffixes with their counts, added up over the portions of a task, and the group that each goes to; a space ends each word, so that
    the order of suffixes is that of a tree."""
    schema = "group long, depth int, lang string, suffix string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for w in portions(batches, portion):
            known, langs = pa.array(w.known, pa.binary()), pa.array(w.langs)
            for at, n, long in ragged_suffixes(w, plan):
                words = [known.take(pa.array(w.code[at + k])).cast(pa.string()) for k in range(long)]
                whole = sum((mix(w.hashed[at + k], k + 21) for k in range(long)), np.zeros(len(at), dtype=np.uint64))
                group, depth = plan.placed(w.hashed[at], w.pair[at], whole, np.full(len(at), long > 1))
                end = pa.array([""] * len(at), pa.string())
                batch = pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(depth.astype(np.int32)), langs.take(pa.array(w.lang[at])), pc.binary_join_element_wise(*words, end, " "), pa.array(n.astype(np.int64))],
                    names=["group", "depth", "lang", "suffix", "n"],
                )
                found.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in found) > 3 * HELD // 4:
                found = together(found)
                if sum(t.num_rows for t in found) > HELD // 2:
                    while found:
                        yield from found.pop().to_batches(max_chunksize=100_000)
                pa.default_memory_pool().release_unused()
        found = together(found) if found else found
        while found:
            yield from found.pop().to_batches(max_chunksize=100_000)

    def together(tables: list[pa.Table]) -> list[pa.Table]:
        """Added up in PARTS by the group, so that only one part at a time is held twice; ``tables`` are freed meanwhile."""
        parts: list[list[pa.Table]] = [[] for _ in range(PARTS)]
        while tables:
            t = tables.pop()
            part = t["group"].to_numpy() % PARTS
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(PARTS + 1))
            for k in range(PARTS):
                if ends[k + 1] > ends[k]:
                    parts[k].append(t.take(pa.array(order[ends[k] : ends[k + 1]])))
        out = []
        while parts:
            if own := parts.pop():
                out.append(pa.concat_tables(own).group_by(["group", "depth", "lang", "suffix"]).aggregate([("n", "sum")]).rename_columns(["group", "depth", "lang", "suffix", "n"]).combine_chunks())
        return out

    return docs.select("text", "lang").mapInArrow(run, schema)


def subtrees(sorted_suffixes: DataFrame, least: int) -> DataFrame:
    """The nodes of the subtrees of sorted suffixes: language, phrase, its words and its count.

    Nodes below the least count are left out, but for those above the prefix of a group and those that the batch may have
    cut: these are parts of counts.
    """
    schema = "lang string, phrase string, words int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("suffix"), " ")
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            offsets, words = offsets[:-1] - offsets[0], np.diff(offsets) - 1
            codes = flat.dictionary_encode().indices.to_numpy()
            depth, n = batch.column("depth").to_numpy(), batch.column("n").to_numpy()
            lang = batch.column("lang").dictionary_encode().indices.to_numpy()
            parted = np.ones(batch.num_rows, dtype=bool)
            parted[1:] = (np.diff(batch.column("group").to_numpy()) != 0) | (np.diff(depth) != 0) | (np.diff(lang) != 0)
            for k in range(DEPTH):
                word = np.where(words > k, codes[offsets + np.minimum(k, words)], -1)
                parted[1:] |= word[1:] != word[:-1]
                at = np.flatnonzero(parted)
                total = np.add.reduceat(n, at)
                keep = (total >= least) | (depth[at] > k + 1)
                keep[[0, -1]] = True
                keep &= word[at] >= 0
                at, total = at[keep], total[keep]
                if len(at):
                    phrase = pc.binary_join_element_wise(*(flat.take(pa.array(offsets[at] + j)) for j in range(k + 1)), " ")
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at)), phrase, pa.array(np.full(len(at), k + 1, dtype=np.int32)), pa.array(total)], names=["lang", "phrase", "words", "n"])

    return sorted_suffixes.mapInArrow(run, schema)


def phrase_counts(docs: DataFrame, least: int = 30, budget: int = 1_000_000, portion: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to DEPTH words that occurs ``least`` times in its language (lang, phrase, words, f), and the
    words of each language (lang, n). docs has text and lang, neither null. ``budget`` is the number of suffixes that a
    group is meant to hold, ``portion`` the bytes of text that a task holds at a time."""
    spark = docs.sparkSession
    cells = stored(cell_counts(docs, portion), "cells")
    langs = stored(cells.filter("kind = 2").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "langs")
    total = langs.agg(F.sum("n")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(1, min(budget, total // (8 * tasks)))
    plan = Plan.of(summed_cells(cells, least, budget).toArrow(), budget)
    dealt = suffixes(docs, plan, portion).repartition(min(max(tasks, plan.groups // 4), 100_000), "group")
    nodes = subtrees(dealt.sortWithinPartitions("group", "depth", "lang", "suffix"), least)
    return stored(nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "nodes"), langs


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, covered: int = 80, most: int = 2_000, **limits: int) -> DataFrame:
    """The phrases of each language whose worst cut is best: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of its two parts, n the words of the language, the score
    floor(2000000 a / (l + r)). Phrases that stand inside a longer one with ``covered`` percent of their count are left
    out. Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur,
    other columns are not touched, a table without words gives no rows. Ties go by count and by the bytes of the phrase.
    """
    whole = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    nodes, langs = phrase_counts(whole, least, **limits)
    long = nodes.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("ws"))
    text = lambda start, size: F.array_join(F.slice("ws", start, size), " ")

    # both parts of every cut find their counts; a word that ends or begins very many phrases is a hot key
    cuts = long.select("lang", "phrase", "a", "words", "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("first"), text(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), text(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"))))
    sided = stored(cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*"), "parts")
    uses = sided.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    counts = stored(uses.join(nodes.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "uses")
    found = join_groups(sided, counts, ["lang", "part"], "uses", sided.count())
    cut = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice("ws", at, size), " "))))
    inner = long.filter("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {covered}")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the first of every share of a language before the first of the language
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = flat.withColumn("at", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("at") <= most).drop("at")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m) WHERE len(ws) >= m),
f AS (SELECT lang, phrase, CAST(m AS BIGINT) AS m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
long AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, m, a, ws, unnest(range(1, m)) AS k FROM long),
cut AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(a) AS longer FROM (
  SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS part FROM long, range(2, 4) t(s), range(1, 4) u(i) WHERE s < m AND i + s - 1 <= m) GROUP BY lang, part)
SELECT w.lang, rank, phrase, a, l, r, n, score FROM (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst x LEFT JOIN inside i ON i.lang = x.lang AND i.part = x.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * a) w JOIN total USING (lang) WHERE rank <= 2000
"""
