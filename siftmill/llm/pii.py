"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

The base spans follow fixed patterns. The field then labels the tokens that could belong to an entity, those with a digit
or an @ and the neighbours of a spelled-out "at" or "dot"; every other word is outside by construction and splits the
chains. Neighbouring tokens share a potential of the chain. Distant tokens of a document that are equal, or that end in
the same digits or name the same mailbox, share skip potentials, so that a sure mention makes a doubtful one surer.
Loopy belief propagation passes messages over both kinds of edges, for learning and for labelling alike. A repeated
token is linked with its first and its last mention before, so that the edges of a document grow with its tokens.

It learns from the base spans of a bounded sample of documents: part of them are rewritten in ways that the patterns do
not know (a mention keeps its label whatever its form), some are mentioned again, and numbers that are nobody's are mixed in.
"""

from __future__ import annotations

import random
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftmill.llm.common import table

#: The kinds in their order, and the patterns of the base spans. A run of digits is read from its start
#: only, and without going back, which finds the same and never reads a long run twice.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: at each @ the longest local part before it that no earlier address holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- tokens, features and edges of a document

SPELLED = re.compile(r"[\[({<](?:at|dot|\.)[\])}>]", re.I)
TRIGGER = re.compile(r"[0-9@]|[\[({<](?:[aA][tT]|[dD][oO][tT]|\.)[\])}>]")
SPACE = re.compile(r"\s")
WORD = re.compile(r"\S+")
OUTSIDE = 0
LABELS = 1 + 2 * len(KINDS)  # outside, then first and further tokens of each kind
KIND_OF = np.array([0] + [1 + k // 2 for k in range(2 * len(KINDS))])
CHAINED, EQUAL, SIMILAR = range(3)


@dataclass
class Graph:
    """Tokens of documents that may belong to an entity, and the edges between them."""

    starts: array = field(default_factory=lambda: array("q"))
    ends: array = field(default_factory=lambda: array("q"))
    joined: array = field(default_factory=lambda: array("b"))  # the token before is in the graph and next to this
    flat: array = field(default_factory=lambda: array("q"))  # earlier, later and kind of each edge
    features: list[list[str]] = field(default_factory=list)  # of tokens to learn from
    scored: array = field(default_factory=lambda: array("d"))  # the labels' scores of tokens to label

    @property
    def edges(self) -> np.ndarray:
        return np.array(self.flat, dtype=np.int64).reshape(-1, 3)


def token_at(text: str, at: int) -> tuple[int, int]:
    start = at
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    end = SPACE.search(text, at)
    return start, end.start() if end else len(text)


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that may belong to an entity, in order."""
    out: list[tuple[int, int]] = []

    def take(token: tuple[int, int]) -> None:
        if not out or token[0] > out[-1][0]:
            out.append(token)

    found = TRIGGER.search(text)
    while found:
        start, end = token_at(text, found.start())
        spelled = SPELLED.search(text, start, end)
        if spelled and (before := len(text[max(0, start - 8) : start].rstrip()) + max(0, start - 8)) and before < start and not text[before - 1].isspace():
            take(token_at(text, before - 1))
        take((start, end))
        if spelled and (after := WORD.search(text, end)):
            take(after.span())
        found = TRIGGER.search(text, end)
    return out


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation and unmatched brackets around it."""
    while start < end and (text[start] in "\"',;:!?<|" or (text[start] == "(" and ")" not in text[start:end])):
        start += 1
    while start < end and (text[end - 1] in "\"',;:!?.>|" or (text[end - 1] == ")" and "(" not in text[start:end])):
        end -= 1
    return start, end


def shape(word: str) -> str:
    """Letters as a, digits as 9 with how many follow each other, the rest as it is."""
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", word))


def described(word: str) -> list[str]:
    number = digits(word)
    parts = re.split(r"[\[({<]?(?:\.|dot)[\])}>]?", word.lower())
    out = ["s" + shape(word), f"n{min(len(number), 20)}", f"d{len(parts)}"]
    if "@" in word:
        out.append("@")
    if SPELLED.search(word):
        out += ["spelled", "spelled " + "".join(sorted({m.lower() for m in SPELLED.findall(word)}))]
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"octets {octets('.'.join(parts))}")
    if 14 <= len(number) <= 19:
        out.append(f"luhn {luhn(number)}")
    return out


def add_document(graph: Graph, text: str, model: SkipChain | None = None) -> None:
    """The tokens of a text, and their edges, put behind those of the documents before: with the model's scores of their
    labels if one is given, else with their features."""
    base = len(graph.starts)
    places = tokens(text)
    cores = [core(text, a, b) for a, b in places]
    words = [text[a:b] for a, b in cores]
    near = [k > 0 and text[places[k - 1][1] : places[k][0]].isspace() and "\n" not in text[places[k - 1][1] : places[k][0]] for k in range(len(places))]
    of = [described(w) for w in words]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k, w in enumerate(words):
        before_it = text[max(0, places[k][0] - 40) : places[k][0]].split()
        features = ["bias", *of[k], *(f"l{x}" for x in (of[k - 1] if near[k] else ["none"])), *(f"r{x}" for x in (of[k + 1] if k + 1 < len(words) and near[k + 1] else ["none"]))]
        if before_it and not near[k]:
            features.append("w" + before_it[-1].lower())
        graph.starts.append(cores[k][0])
        graph.ends.append(cores[k][1])
        graph.joined.append(near[k])
        if model is None:
            graph.features.append(features)
        else:
            graph.scored.extend(model.weights[[i for f in features if (i := model.index.get(f)) is not None]].sum(axis=0))
        if near[k]:
            graph.flat.extend((base + k - 1, base + k, CHAINED))
        number = digits(w)
        keys = [number[-7:]] if len(number) >= 7 else []
        local = re.split(r"@|[\[({<]at[\])}>]", w.lower())[0]
        keys += [local + "@"] if len(local) > 2 and local != w.lower() else []
        for key in keys:
            for other in sorted({first.get(key), last.get(key)} - {None}):
                if not (near[k] and other == k - 1):
                    graph.flat.extend((base + other, base + k, EQUAL if words[other] == w else SIMILAR))
            first.setdefault(key, k)
            last[key] = k


# ---------------------------------------------------------------- loopy belief propagation and learning


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def messages(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int, damping: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Log beliefs of the tokens, and what every end of an edge believes without the edge.

    Messages go both ways over all edges at once, ``rounds`` times, each damped by the one before; on a graph without
    loops that no path of more edges crosses, the beliefs are exact but for the damping.
    """
    ends = np.stack([edges[:, :2], edges[:, 1::-1]], axis=1).reshape(-1, 2)  # 2k: earlier to later, 2k + 1: back
    both = np.concatenate([tables, tables.transpose(0, 2, 1)])
    kind = np.stack([edges[:, 2], edges[:, 2] + len(tables)], axis=1).reshape(-1)
    sent = np.zeros((len(ends), unary.shape[1]))
    back = np.arange(len(ends)) ^ 1

    def beliefs() -> np.ndarray:
        total = unary.copy()
        for label in range(unary.shape[1]):
            total[:, label] += np.bincount(ends[:, 1], sent[:, label], len(unary))
        return total

    for _ in range(rounds):
        open_ = beliefs()[ends[:, 0]] - sent[back]
        for at in range(0, len(ends), 1 << 15):
            part = slice(at, at + (1 << 15))
            new = log_sum(open_[part, :, None] + both[kind[part]], axis=1)
            new -= log_sum(new, axis=1)[:, None]
            sent[part] = new + damping * (sent[part] - new)
    total = beliefs()
    return total, total[ends[:, 0]] - sent[back]


@dataclass
class SkipChain:
    """Weights of features by label, of neighbours by their labels, and of skip edges by the kinds of their ends."""

    index: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray
    skips: np.ndarray

    def tables(self) -> np.ndarray:
        return np.concatenate([self.chain[None], self.skips[:, KIND_OF][:, :, KIND_OF]])

    def marginals(self, graph: Graph, rounds: int = 12) -> np.ndarray:
        unary = np.array(graph.scored).reshape(-1, LABELS)
        total, _ = messages(unary, graph.edges, self.tables(), rounds)
        return np.exp(total - log_sum(total, axis=1)[:, None]) if len(total) else total


def fit(graph: Graph, gold: np.ndarray, epochs: int = 80, rate: float = 0.08, prior: float = 0.02, least_seen: int = 3, rounds: int = 6) -> SkipChain:
    """Weights by ascent (Adam) on the likelihood, its gradients by loopy propagation, with a Gaussian prior."""
    seen = Counter(f for fs in graph.features for f in fs)
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least_seen))}
    flat = [(k, index[f]) for k, fs in enumerate(graph.features) for f in fs if f in index]
    owner, ids = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 2
    edges = graph.edges
    theta = [np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, 1 + len(KINDS), 1 + len(KINDS)))]
    m, v = ([np.zeros_like(t) for t in theta] for _ in range(2))
    want = np.eye(LABELS)[gold]

    def by_kind(of: np.ndarray, pick: np.ndarray) -> np.ndarray:
        out = np.zeros((1 + len(KINDS), 1 + len(KINDS)))
        np.add.at(out, (KIND_OF[:, None], KIND_OF[None, :]), of[pick].sum(axis=0))
        return out

    for step in range(1, epochs + 1):
        model = SkipChain(index, *theta)
        unary = np.stack([np.bincount(owner, theta[0][ids, label], len(gold)) for label in range(LABELS)], axis=1)
        tables = model.tables()
        total, open_ = messages(unary, edges, tables, rounds)
        miss = want - np.exp(total - log_sum(total, axis=1)[:, None])
        pair = open_[::2][:, :, None] + open_[1::2][:, None, :] + tables[edges[:, 2]]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair = want[edges[:, 0]][:, :, None] * want[edges[:, 1]][:, None, :] - pair / pair.sum(axis=(1, 2), keepdims=True)
        grads = [np.stack([np.bincount(ids, miss[owner, label], len(index)) for label in range(LABELS)], axis=1), pair[edges[:, 2] == CHAINED].sum(axis=0)]
        grads.append(np.stack([by_kind(pair, edges[:, 2] == kind) for kind in (EQUAL, SIMILAR)]))
        for k, g in enumerate(grads):
            g = g - prior * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return SkipChain(index, *theta)


# ---------------------------------------------------------------- what to learn from


def condensed(text: str | None, around: int = 24) -> str:
    """The surroundings of a text's tokens, one a line; what is between them is left out."""
    spans: list[list[int]] = []
    for a, b in tokens(text or ""):
        a, b = max(0, a - around), min(len(text), b + around)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return "\n".join(text[a:b].replace("\n", " ") for a, b in spans)


def rewritten(mention: str, kind: int, rng: random.Random) -> str:
    """A mention in a form that the patterns do not find."""
    d = digits(mention)
    if kind == 0:
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("{at}", "{dot}")])
        local, _, domain = mention.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return mention.replace(".", rng.choice(["[.]", "(.)", "[dot]", "(dot)"]))
    if kind == 2:
        return rng.choice("._/").join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{d[:-10]} {a} {b} {c}", f"{d[:-10]}-{a}-{b}-{c}"])


def nobodys(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda a, b: str(rng.randint(a, b))
    card = "".join(rng.choice("0123456789") for _ in range(16))
    card = card[:-1] + str((int(card[-1]) + 1) % 10) if luhn(card) else card
    octet = [n(0, 255) for _ in range(4)]
    octet[rng.randrange(4)] = n(256, 999)
    forms = [
        f"{n(1900, 2100)}-{n(10, 12)}-{n(10, 28)}", f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2100)}", f"{n(0, 23)}:{n(10, 59)}", f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}",
        f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", n(1, 99_999_999), f"#{n(1000, 999_999)}", f"{n(1, 100)}%", f"{n(1900, 2100)}-{n(1900, 2100)}", card,
        rng.choice("._/").join(card[k : k + 4] for k in range(0, 16, 4)), f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", rng.choice(["[.]", "(.)"]).join(octet),
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))), f"{n(1, 9)}.{n(100, 999)}.{n(100, 999)}.{n(100, 999)}", f"{n(1, 99)}/{n(1, 99)}", f"{n(1, 99)}-{n(1, 99)}-{n(1, 99)}", f"@{rng.choice(['home', 'team', 'news'])}", f"{n(100, 999)}-{n(10, 99)}",
        f"{n(1, 9)} [at] {n(1, 9)}", f"{n(1, 99)} {n(1, 999)} {n(1, 9999)}", f"{n(1000, 9999)} {n(1000, 9999)}", f"({n(1900, 2100)}) {n(1, 99)}-{n(1, 99)}",
    ]
    return rng.choice(forms)


def lesson(text: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A text to learn from and its entities: those of the patterns, some in other forms or mentioned again."""
    out, spans, at, mentions = [], [], 0, []

    def put(piece: str, kind: int | None = None) -> None:
        start = sum(map(len, out))
        out.append(piece)
        if kind is not None:
            spans.append((start, kind, start + len(piece)))

    for a, kind, b in base_spans(text):
        if a < at:
            continue
        put(text[at:a])
        mention = text[a:b]
        mentions.append((mention, kind))
        put(rewritten(mention, kind, rng) if rng.random() < 0.4 else mention, kind)
        at = b
    put(text[at:])
    for _ in range(rng.choice([0, 0, 1, 2])):
        if mentions:
            mention, kind = rng.choice(mentions)
            put(rng.choice([" or ", ", ", " again ", "\n"]))
            put(rewritten(mention, kind, rng) if rng.random() < 0.7 else mention, kind)
    for _ in range(rng.choice([0, 1, 2, 3])):
        number = nobodys(rng)
        for _ in range(rng.choice([1, 1, 2])):
            put(rng.choice([" of ", ", the ", " in ", "\nsince "]))
            put(number)
    return "".join(out), spans


def labelled(texts: list[str], seed: int = 11) -> tuple[Graph, np.ndarray]:
    """The graph of lessons made of condensed texts, and the labels of its tokens."""
    rng = random.Random(seed)
    graph, gold = Graph(), []
    for text in texts:
        taught, spans = lesson(text, rng)
        begin = len(graph.starts)
        add_document(graph, taught)
        for a, b in zip(graph.starts[begin:], graph.ends[begin:], strict=True):
            inside = next(((s, k) for s, k, e in spans if s < b and a < e), None)
            gold.append(OUTSIDE if inside is None else 1 + 2 * inside[1] + (a > inside[0]))
    return graph, np.array(gold, dtype=np.int64)


def learn(docs: DataFrame, sample: int = 1_500, longest: int = 2_000, seed: int = 11) -> SkipChain:
    """A model from at most ``sample`` documents with a base span, the first by a hash. Only the surroundings of their
    tokens come to the driver, at most ``longest`` characters of each; documents with more are not taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [condensed(t.as_py()) for t in batch.column("text")]
            keep = [k for k, s in enumerate(short) if s and len(s) <= longest and base_spans(s)]
            yield pa.RecordBatch.from_arrays([pa.array([short[k] for k in keep], pa.string())], names=["short"])

    # rows with no digit and no @ cannot have one; the smaller hashes are taken, of equal texts one
    short = docs.select("text").filter("text RLIKE '[0-9@]'").mapInArrow(run, "short string").distinct()
    chosen = short.orderBy(F.xxhash64("short", F.lit(seed)), "short").limit(sample)
    return fit(*labelled([r["short"] for r in chosen.collect()], seed))


# ---------------------------------------------------------------- finding


def added_spans(graph: Graph, marginals: np.ndarray, base: list[list[Span]], owners: np.ndarray, sure: float) -> list[list[Span]]:
    """For each document, the spans of tokens that are surely of one kind and that no base span touches."""
    out: list[list[Span]] = [[] for _ in base]
    if not len(marginals):
        return out
    by_kind = np.stack([marginals[:, KIND_OF == k].sum(axis=1) for k in range(1 + len(KINDS))], axis=1)
    kind, sureness, best = by_kind.argmax(axis=1), by_kind.max(axis=1), marginals.argmax(axis=1)
    k = 0
    while k < len(kind):
        end = k + 1
        while kind[k] and end < len(kind) and graph.joined[end] and kind[end] == kind[k] and owners[end] == owners[k] and best[end] != 2 * kind[k] - 1:
            end += 1
        if kind[k] and sureness[k:end].min() >= sure:
            doc, a, b = owners[k], graph.starts[k], graph.ends[end - 1]
            if a < b and not any(s < b and a < e for s, _, e in base[doc]):
                out[doc].append((a, int(kind[k]) - 1, b))
        k = end
    return out


def personal_data(docs: DataFrame, model: SkipChain, text_col: str = "text", sure: float = 0.9, at_once: int = 50_000) -> DataFrame:
    """``docs`` with a column pii: the counts of base spans by kind, the base spans and all spans as texts.

    Spans are code points of the whole text, the end exclusive; null counts as empty. Spans that the field adds touch no
    base span; a token is added where its kind has a probability of ``sure`` or more. Repeated rows are each read, all
    columns are carried (one named pii is replaced), no rows give no rows.
    """
    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t) if isinstance(t, str) else [] for t in texts]
            more: list[list[Span]] = [[] for _ in base]
            graph, owners, begin = Graph(), [], 0
            for k, t in enumerate(texts):
                before = len(graph.starts)
                if isinstance(t, str):
                    add_document(graph, t, model)
                owners += [k - begin] * (len(graph.starts) - before)
                if len(owners) >= at_once or k == len(base) - 1:
                    more[begin : k + 1] = added_spans(graph, model.marginals(graph), base[begin : k + 1], np.array(owners, dtype=np.int64), sure)
                    graph, owners, begin = Graph(), [], k + 1
            rows = [(*(sum(s[1] == kind for s in b) for kind in range(len(KINDS))), len(m), written(b), written(sorted(b + m))) for b, m in zip(base, more, strict=True)]
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"])

    return docs.withColumn("pii", find(F.col(text_col)))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document; the counts and the digest are of the base spans, n_added counts the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, learn(docs)).select("doc_id", "pii.*")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
