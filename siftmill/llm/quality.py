"""Quality scores by a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in turn; each step fits a shallow tree to the
gradients summed by bin and adds its leaves, times a small rate, to the feature's lookup table. Pairs of features whose
joint bins still explain the residuals then get two-dimensional tables in the same way. A score is the sum of the
tables' entries at a text's bins, through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftmill.llm.common import held_out, table

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "top_pair", "same_as_before", "capital_words",
    "upper_words", "upper_letters", "digits", "full_stops", "commas", "bars", "symbols", "high_bytes", "line_breaks",
    "repeated_lines", "stopped_words", "short_words", "long_words", "byte_entropy", "longest_share", "once_words",
)
_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "letter": ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    "high": _BYTES >= 128,
}
_PLAIN = np.isin(_BYTES, list(b".,;:'\"()-"))
_SYMBOL = ~(_CLASSES["upper"] | _CLASSES["letter"] | _CLASSES["digit"] | _CLASSES["space"] | _CLASSES["high"] | _PLAIN)


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = text.split()
    n, size = max(len(words), 1), len(raw)
    by_word = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = max(int(counts[_CLASSES["letter"]].sum()), 1)
    return [
        np.log1p(size),
        np.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        len(by_word) / n,
        max(by_word.values(), default=0) / n,
        max(pairs.values(), default=0) / n,
        sum(v for (a, b), v in pairs.items() if a == b) / n,
        sum(w[0].isupper() for w in words) / n,
        sum(map(str.isupper, words)) / n,
        float(counts[_CLASSES["upper"]].sum()) / letters,
        float(counts[_CLASSES["digit"]].sum()) / size,
        float(counts[46]) / n,
        float(counts[44]) / n,
        float(counts[124]) / n,
        float(counts[_SYMBOL].sum()) / size,
        float(counts[_CLASSES["high"]].sum()) / size,
        float(counts[10]) / n,
        1 - len(set(lines)) / len(lines),
        sum(w[-1] in ".!?" for w in words) / n,
        float((lengths <= 2).sum()) / n,
        float((lengths >= 12).sum()) / n,
        float(-(share * np.log2(share)).sum()),
        float(lengths.max()) / size if len(words) else 0.0,
        sum(v == 1 for v in by_word.values()) / n,
    ]


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def tree_over_bins(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """A value for every bin: best-first cuts of the ordered bins into at most so many leaves."""
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]

    def best_cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        mid = np.arange(lo + 1, hi)
        gl, hl = cg[mid] - cg[lo], ch[mid] - ch[lo]
        gr, hr = cg[hi] - cg[mid], ch[hi] - ch[mid]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
        gain[(hl < least) | (hr < least)] = 0.0
        k = int(gain.argmax())
        return float(gain[k]), int(mid[k])

    parts = [(0, len(g), *best_cut(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, gain, mid = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(lo, mid, *best_cut(lo, mid)), (mid, hi, *best_cut(mid, hi))]
    out = np.zeros(len(g))
    for lo, hi, *_ in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cross of one cut in each of two features: its gain and the value of every cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = []
    for c, t in ((cg, tg), (ch, th)):
        low = c[:-1, :-1]
        left, top = c[:-1, -1:] + 0 * low, c[-1:, :-1] + 0 * low
        parts.append(np.stack([low, left - low, top - low, t - left - top + low]))
    gain = (parts[0] ** 2 / (parts[1] + ridge)).sum(0) - tg**2 / (th + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = parts[0][:, i, j] / (parts[1][:, i, j] + ridge)
    cells = np.empty_like(g)
    cells[: i + 1, : j + 1], cells[: i + 1, j + 1 :] = value[0], value[1]
    cells[i + 1 :, : j + 1], cells[i + 1 :, j + 1 :] = value[2], value[3]
    return float(gain[i, j]), cells


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for k, values in enumerate(self.tables):
            f += values[b[:, k]]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            f += values[self.coarse[i, b[:, i]], self.coarse[j, b[:, j]]]
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 4, least: float = 1.0, ridge: float = 1.0, cells: int = 8) -> AdditiveModel:
    """Cyclic boosting of the main tables, then of the tables of the pairs with most gain. One class or no rows: a constant."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    base = np.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0.0
    model = AdditiveModel(edges, float(base), [np.zeros(len(e) + 1) for e in edges])
    model.coarse = np.stack([np.minimum(np.arange(bins + 1) * cells // (len(e) + 1), cells - 1) for e in edges]).astype(np.int64)
    if n == 0 or y.min() == y.max():
        return model
    b, f = model.bins(x), np.full(n, float(base))
    columns = [np.ascontiguousarray(b[:, k]) for k in range(width)]
    for _ in range(rounds):
        for k in range(width):
            p = 1 / (1 + np.exp(-f))
            size = len(edges[k]) + 1
            step = rate * tree_over_bins(np.bincount(columns[k], y - p, size), np.bincount(columns[k], p * (1 - p), size), leaves, least, ridge)
            model.tables[k] += step
            f += step[columns[k]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        cell = model.coarse[i, columns[i]] * cells + model.coarse[j, columns[j]]
        return cell, np.bincount(cell, y - p, cells * cells).reshape(cells, cells), np.bincount(cell, p * (1 - p), cells * cells).reshape(cells, cells)

    ranked = sorted(((quadrants(*sums(i, j)[1:], ridge)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((cells, cells)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for at, (i, j) in enumerate(model.pairs):
            cell, g, h = sums(i, j)
            step = rate * quadrants(g, h, ridge)[1]
            model.pair_tables[at] += step
            f += step.reshape(-1)[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> AdditiveModel:
    """A model from at most ``sample`` labelled rows outside the held-out fold, the first by a hash of the id.

    Rows without a label or a document teach nothing, an id that occurs repeatedly teaches once. Only this bounded sample of features comes to the driver.
    """
    chosen = labels.select("doc_id", "quality").filter("quality IS NOT NULL").filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    extract = pandas_udf(lambda s: pd.Series(list(feature_rows(s))), "array<double>")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", extract("text").alias("x"), "quality")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 for every whole text; null and empty texts get the model's score of no text."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(feature_rows(texts)), dtype="float64")

    return docs.withColumn(into, score(F.col(text_col)))


def op3_quality(spark: SparkSession, sf_dir: str, accept: float = 0.3) -> DataFrame:
    """Every document with its quality score and whether it is accepted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
