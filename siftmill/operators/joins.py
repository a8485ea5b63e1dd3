"""Joins of postings with registers, parents, tasks, domains, caches and answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.operators.links import links_of
from siftmill.operators.survivorship import few_edits, gram_pairs


def fuzzy_register(names: DataFrame, register: DataFrame, name: str, legal: str, similarity, least: float) -> DataFrame:
    """Names with the register's best like name: exact ones first, then those of at least the similarity.

    Only distinct names are compared, and only with register names that share a rare gram with them at about the same
    place and whose length lies in the band that the similarity allows. ``similarity`` must not exceed the indel ratio, as that
    of matching blocks does not: then no name is lost.
    """
    exact = names.join(register, F.col(name) == F.col(legal)).select(name, legal, F.lit(1.0).alias("similarity"))
    rest = names.join(register, F.col(name) == F.col(legal), "left_anti")
    left, right = rest.select(F.col(name).alias("s")).distinct(), register.select(F.col(legal).alias("s")).distinct()
    pairs = gram_pairs(left, right, least).toDF(name, legal).unionByName(gram_pairs(right, left, least).toDF(legal, name)).distinct()
    n, m = F.length(name), F.length(legal)
    near = pairs.filter((m * (2 - least) >= n * least) & (n * (2 - least) >= m * least)).filter(few_edits(name, legal, least)).withColumn("similarity", similarity(name, legal)).filter(F.col("similarity") >= least)
    best = near.groupBy(name).agg(F.max_by(legal, F.struct("similarity", legal)).alias(legal), F.max("similarity").alias("similarity"))
    return exact.unionByName(best)


def parent_or_first(children: DataFrame, parents: DataFrame, referrer: Column, parent_key: str, domain: str) -> DataFrame:
    """Children with the parent that they refer to, else the first of their domain; others go."""
    direct = parents.select(F.col(parent_key).alias("_ref"), F.col(parent_key).alias("_direct"))
    first = parents.groupBy(domain).agg(F.min(parent_key).alias("_first"))
    found = children.withColumn("_ref", referrer).join(direct, "_ref", "left").join(first, domain, "left")
    return found.withColumn("parent_id", F.coalesce("_direct", "_first")).filter("parent_id IS NOT NULL").drop("_ref", "_direct", "_first")


def by_domain_suffix(pages: DataFrame, known: DataFrame, id_col: str, host: Column) -> DataFrame:
    """Each page with the longest known domain that is its host or a parent of it."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    rows = pages.select(id_col, F.explode(suffixes).alias("domain"))
    return rows.join(known, "domain").groupBy(id_col).agg(F.max_by("domain", F.length("domain")).alias("domain"))


def new_links(pages: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The first links of each page that are not known."""
    fresh = links_of(pages).join(known, "href", "left_anti").groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return fresh.withColumn("rn", rank).filter(F.col("rn") <= most).select("page_id", "href")


def cached_verdicts(rows: DataFrame, cache: DataFrame, key: str, verdict: str) -> DataFrame:
    """Rows with the latest verdict of their key (``latest``) and whether there is one (``hit``)."""
    last = cache.groupBy(key).agg(F.max_by(verdict, F.struct("ts", verdict)).alias("latest"))
    return rows.join(last, key, "left").withColumn("hit", F.col("latest").isNotNull())


def reassociated(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with the answer of the following turn; a turn answered twice counts as unanswered."""
    one = answers.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("answered")).filter("n = 1")
    return questions.select("conv_id", "turn", F.col("text").alias("asked")).join(one.drop("n"), ["conv_id", "turn"], "left")


#: Quotes of so many characters together are sent to every task; more are joined by their windows.
QUOTE_CHARS = 16 << 20
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def containing(quotes: DataFrame, texts: DataFrame, window: int = 24, least: int = 6, share: int = 16) -> DataFrame:
    """Pairs (item_id, doc_id) where the text t holds the whole quote q, which has at least so many characters.

    Quotes and texts are ASCII letters and digits. Texts are looked through in place by a rolling hash of windows as wide
    as ``window``, or as the quote if that is shorter, and a hit is read character by character. That takes the quotes
    into every task, so they must be few; where they are counted to be too many, texts and quotes meet in a join.
    """
    long = quotes.filter(F.length("q") >= least).select("item_id", "q")
    if long.agg(F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("n")).first()["n"] > QUOTE_CHARS:
        return containing_by_join(long, texts, window, share)
    known = long.toArrow().combine_chunks()
    kinds = dict(quotes.dtypes)["item_id"], dict(texts.dtypes)["doc_id"]
    find, items = finder(known["q"].to_pylist(), window), known["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("t").to_pylist()):
                for q in find(text or ""):
                    rows.append(k)
                    found.append(q)
            yield pa.RecordBatch.from_arrays([items.take(pa.array(found, pa.int64())).combine_chunks(), batch.column("doc_id").take(pa.array(rows, pa.int64()))], names=["item_id", "doc_id"])

    return texts.select("doc_id", "t").mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}")


def finder(quotes: list[str], window: int):
    """A function from a text to the numbers of the quotes that it holds."""
    by_width: dict[int, dict[int, list[int]]] = {}
    for k, q in enumerate(quotes):
        width = min(len(q), window)
        h = sum(c * pow(_PRIME, i, 1 << 64) for i, c in enumerate(q[:width].encode())) & ((1 << 64) - 1)
        by_width.setdefault(width, {}).setdefault(h, []).append(k)
    heads = {}
    for width, owners in by_width.items():
        hashes = np.array(sorted(owners), dtype=np.uint64)
        marked = np.zeros(1 << 16, dtype=bool)
        marked[hashes >> np.uint64(48)] = True
        heads[width] = (hashes, marked, owners)
    powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}

    def find(text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint64)
        if len(raw) > len(powers["up"]):
            for name, base in (("up", _PRIME), ("down", _INVERSE)):
                powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(raw), base, dtype=np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(raw * powers["up"][: len(raw)])]
        found: set[int] = set()
        for width, (hashes, marked, owners) in heads.items():
            if width > len(raw):
                continue
            h = (sums[width:] - sums[:-width]) * powers["down"][: len(raw) - width + 1]
            at = np.flatnonzero(marked[h >> np.uint64(48)])
            at = at[np.isin(h[at], hashes)]
            for place, key in zip(at.tolist(), h[at].tolist(), strict=True):
                found.update(q for q in owners[key] if q not in found and text.startswith(quotes[q], place))
        return sorted(found)

    return find


def containing_by_join(quotes: DataFrame, texts: DataFrame, window: int = 24, share: int = 16) -> DataFrame:
    """As ``containing``, by a join of windows.

    Only windows whose hash is divisible by ``share`` are joined: a quote has such a window at the same place in every
    text that holds it. Quotes that have none are joined by their first window with all windows of the texts.
    """
    spots = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - F.col("w") + 1), lambda i: F.substr(c, i, F.col("w")))
    chosen = lambda x: F.xxhash64(x) % share == 0
    q = quotes.withColumn("w", F.least(F.length("q"), F.lit(window)))
    q = q.withColumn("head", F.try_element_at(F.filter(spots("q"), chosen), F.lit(1)))
    some, none = q.filter("head IS NOT NULL"), q.filter("head IS NULL").withColumn("head", F.substr("q", F.lit(1), F.col("w")))

    def found(heads: DataFrame, pick) -> DataFrame:
        # at most ``window`` widths
        probe = texts.join(F.broadcast(heads.select("w").distinct())).filter(F.length("t") >= F.col("w"))
        probe = probe.select("doc_id", "w", F.explode(F.array_distinct(pick(spots("t")))).alias("head"))
        return probe.join(heads, ["w", "head"]).select("item_id", "doc_id", "q").distinct()

    pairs = found(some, lambda xs: F.filter(xs, chosen))
    if not none.isEmpty():
        pairs = pairs.unionByName(found(none, lambda xs: xs))
    return pairs.join(texts, "doc_id").filter(F.col("t").contains(F.col("q"))).select("item_id", "doc_id")
