"""Hard negatives by an inverted multi-index: exact best rows of each anchor in windows of the score.

Vectors are cut into two halves, each with a codebook of its own; a cell is a pair of codes. How far the members of a code
lie from it at most, its radius, bounds what any member can add to the inner product with an anchor. An anchor visits the
cells in the order of the summed bounds of their halves, which a heap merges from the two sorted lists of codes, and stops
when each of its windows is certified: what was found cannot be beaten or tied by any cell that comes later, or no later
cell reaches the window. So the result is exact, however good the codebooks are; they only decide how many cells an
anchor has to see.

Anchors go in rounds, each of which lets those that are still open visit more cells than the one before. A round meets
visits and members in the parts of cells: a cell of any size is parts of bounded size, and many visits of one part are
several chunks. Of rows with the same vector and label only the few with the least ids can be among the first of any
anchor; they stand for all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.common import join_groups, stored, table
from siftmill.llm.embedding_dedup import matrix

#: Most codes of a half, sampled vectors for each code to fit a codebook on, rows of a cell that are aimed at.
MOST_CODES, SAMPLED, CELL = 256, 64, 512
#: Rows of a part of a cell, and visits of it that one task holds against them.
PART, CHUNK = 2_048, 4_096
#: Rows that an anchor sees in the first round; each round sees GROWTH times as many.
FIRST, GROWTH = 8_192, 8
#: Components of quantised vectors, and components of a vector: with these no inner product leaves 64 bits.
LARGEST, LONGEST = 1 << 25, 1 << 12


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256.0))


def finite(vector: Column) -> Column:
    """A vector whose components are all there, finite and small enough for exact inner products."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST / 256 - 1))
    return F.coalesce(~bad & (F.size(vector) <= LONGEST), F.lit(False))


def codebook(rows: np.ndarray, codes: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centres by k-means from starts that are drawn far from each other."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.integers(len(rows), size=1)]
    far = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < codes and far.sum() > 0:
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=far / far.sum())]])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(rows, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    own = ((centres * centres).sum(axis=1)[None, :] - 2 * (rows @ centres.T)).argmin(axis=1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(axis=1))


@dataclass
class MultiIndex:
    """The codebooks, and of every cell its rows, its parts and the radii of its halves."""

    books: tuple[np.ndarray, np.ndarray]
    width: int
    rows: dict[tuple[int, int], int]
    cell_radii: dict[tuple[int, int], tuple[float, float]]
    radii: tuple[np.ndarray, np.ndarray]

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[..., : self.width // 2], v[..., self.width // 2 :]

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """The cells that have rows, by falling sum of their halves' bounds: the two codes, that sum, and the most and the
        least that the score of a row in the cell can be."""
        halves = self.halves(anchor.astype(float))
        scores = [b @ q for b, q in zip(self.books, halves, strict=True)]
        sizes = [math.sqrt(q @ q) for q in halves]
        bounds = [s + z * r for s, z, r in zip(scores, sizes, self.radii, strict=True)]
        order = [np.argsort(-b, kind="stable") for b in bounds]
        (first, second), (a, b) = bounds, order
        slack = 1 + 1e-9 * sum(float(np.abs(x).max()) + z * float(r.max(initial=0)) for x, z, r in zip(scores, sizes, self.radii, strict=True))
        heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
        seen = {(0, 0)}
        while heap:
            bound, x, y = heapq.heappop(heap)
            for step in ((x + 1, y), (x, y + 1)):
                if step not in seen and step[0] < len(a) and step[1] < len(b):
                    seen.add(step)
                    heapq.heappush(heap, (-(first[a[step[0]]] + second[b[step[1]]]), *step))
            seen.discard((x, y))
            cell = (int(a[x]), int(b[y]))
            if cell in self.rows:
                centre = scores[0][cell[0]] + scores[1][cell[1]]
                reach = sum(z * r for z, r in zip(sizes, self.cell_radii[cell], strict=True))
                yield *cell, slack - bound, centre + reach + slack, centre - reach - slack


def build(base: DataFrame, most_codes: int, cell_rows: int) -> tuple[MultiIndex | None, DataFrame]:
    """The index of ``base`` (id, label, v), and the rows with their cell and its part.

    The codebooks are fitted on a bounded sample, at most SAMPLED * most_codes rows, the first by a hash; every row is
    indexed."""
    n, width = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None, base
    codes = max(1, min(most_codes, round(math.sqrt(n / cell_rows))))
    sample = base.orderBy(F.xxhash64("id", F.lit(1)), "id", "label", "v").select("v").limit(SAMPLED * codes).toArrow()
    rows, _ = matrix(sample["v"].combine_chunks(), width)
    books = tuple(codebook(half, codes) for half in (rows[:, : width // 2], rows[:, width // 2 :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, _ = matrix(batch.column("v"), width)
            (a, far_a), (b, far_b) = nearest(v[:, : width // 2], books[0]), nearest(v[:, width // 2 :], books[1])
            more = [pa.array(x) for x in (a.astype(np.int32), b.astype(np.int32), far_a, far_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "a", "b", "far_a", "far_b"])

    placed = stored(base.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<long>, a int, b int, far_a double, far_b double"), "cells")
    known = stored(placed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("far_a").alias("ra"), F.max("far_b").alias("rb")), "radii")
    cells = known.collect()  # at most most_codes squared
    radii = tuple(np.zeros(len(b)) for b in books)
    for c in cells:
        radii[0][c["a"]] = max(radii[0][c["a"]], c["ra"])
        radii[1][c["b"]] = max(radii[1][c["b"]], c["rb"])
    index = MultiIndex(books, width, {(c["a"], c["b"]): c["n"] for c in cells}, {(c["a"], c["b"]): (c["ra"], c["rb"]) for c in cells}, radii)
    parts = F.ceil(F.col("n") / PART)
    members = placed.join(F.broadcast(known.select("a", "b", "n")), ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    return index, members.select("a", "b", "part", "id", "label", "v")


#: The state of an anchor: its number and row, whether its windows are for rows of its label, their least and greatest
#: scores, what was found for each of them, and the cells visited.
STATE = ("anchor", "id", "label", "v", "same", "low", "high", "best", "visited")
FOUND = "array<struct<w: int, neg: long, other: long>>"


def next_visits(state: DataFrame, index: MultiIndex, rows: int, need: int) -> DataFrame:
    """The parts of cells that each open anchor visits next, of so many rows or more; certified anchors visit none."""
    schema = "a int, b int, part int, anchor long, id long, label long, v array<long>, same boolean, low array<long>, high array<long>, after int"
    carried = ["anchor", "id", "label", "v", "same", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64))):
            vectors, _ = matrix(batch.column("v"), index.width)
            lows, highs, bests, visited = (batch.column(c).to_pylist() for c in ("low", "high", "best", "visited"))
            out: list[list[int]] = [[], [], [], [], []]
            for k, q in enumerate(vectors):
                floor = [low if low <= high else math.inf for low, high in zip(lows[k], highs[k], strict=True)]
                for w in range(len(floor)):
                    found = [-x["neg"] for x in bests[k] if x["w"] == w]
                    if len(found) >= need:
                        floor[w] = max(floor[w], found[need - 1])
                lowest, highest = min(floor, default=math.inf), max(highs[k], default=-math.inf)
                begin, taken, at = len(out[0]), 0, 0
                for at, (a, b, bound, most, least) in enumerate(index.cells(q)):
                    if at < visited[k]:
                        continue
                    if bound < lowest or taken >= rows:  # certified, or enough for this round
                        break
                    if most >= lowest and least <= highest:
                        n = index.rows[a, b]
                        taken += n
                        for part in range(-(-n // PART)):
                            for column, value in zip(out, (a, b, part, k, 0), strict=True):
                                column.append(value)
                else:
                    at += 1
                out[4][begin:] = [at] * (len(out[4]) - begin)
            if out[0]:
                own = batch.select(carried).take(pa.array(out[3]))
                a, b, part, after = (pa.array(out[x], pa.int32()) for x in (0, 1, 2, 4))
                yield pa.RecordBatch.from_arrays([a, b, part, *own.columns, after], names=["a", "b", "part", *carried, "after"])

    return state.mapInArrow(run, schema)


def firsts(scores: np.ndarray, valid: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first of each row by falling score, then by column; only valid ones."""
    n = scores.shape[1]
    if n > need and np.abs(scores).max(initial=0) < (1 << 62) // (n + 1) - 1:
        key = np.where(valid, -scores.astype(np.int64) * n + np.arange(n), np.iinfo(np.int64).max)
        top = np.argpartition(key, need - 1, axis=1)[:, :need]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(key, top, axis=1), axis=1, kind="stable"), axis=1)
    else:
        top = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, ~valid), axis=1)[:, :need]
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    col = top.reshape(-1)
    keep = valid[row, col]
    return row[keep], col[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: as doubles while these hold them, else as 64-bit numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def seen(visits: DataFrame, members: DataFrame, width: int, need: int) -> DataFrame:
    """What each visit finds: anchor, window, negated score and the other row's id, at most ``need`` a window."""
    keys = ["a", "b", "part"]
    sizes = stored(visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("visits")), "sizes")
    chunks = F.ceil(F.col("visits") / CHUNK)
    sent = join_groups(visits, sizes, keys, "visits", visits.count()).withColumn("chunk", F.pmod(F.xxhash64("anchor"), chunks))
    held = members.join(sizes, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    none = {"anchor": "long", "same": "boolean", "low": "array<long>", "high": "array<long>"}
    columns = [*keys, "chunk", "anchor", "id", "label", "v", "same", "low", "high"]
    both = held.select(*[F.lit(None).cast(none[c]).alias(c) if c in none else c for c in columns]).unionByName(sent.select(*columns))
    tasks = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, *keys, "chunk").sortWithinPartitions(*keys, "chunk", F.col("anchor").isNotNull(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in (*keys, "chunk")])
            asks = batch.column("anchor").is_valid().to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.flatnonzero((np.diff(at, axis=1) != 0).any(axis=0) | (asks[1:] != asks[:-1])) + 1, batch.num_rows]
            for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if key != (own := tuple(at[:, begin].tolist())):
                    key, block = own, []
                if not asks[begin]:
                    block.append((part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), width)[0]))
                    continue
                if len(block) > 1:
                    block = [tuple(np.concatenate(x) for x in zip(*block, strict=True))]
                for start in range(0, part.num_rows if block else 0, 512):
                    yield from asked(part.slice(start, 512), *block[0])

    def asked(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores = products(matrix(part.column("v"), width)[0], rows)
        equal = part.column("label").to_numpy()[:, None] == labels[None, :]
        same = part.column("same").to_numpy(zero_copy_only=False)[:, None]
        fits = (equal == same) & (part.column("id").to_numpy()[:, None] != ids[None, :])
        low, high, anchor = part.column("low").to_pylist(), part.column("high").to_pylist(), part.column("anchor").to_numpy()
        for w in range(max(map(len, low))):
            least = np.array([x[w] if w < len(x) else np.iinfo(np.int64).max for x in low])[:, None]
            most = np.array([x[w] if w < len(x) else np.iinfo(np.int64).min for x in high])[:, None]
            row, col = firsts(scores, fits & (scores >= least) & (scores <= most), need)
            if len(row):
                found = -scores[row, col].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(np.full(len(row), w, dtype=np.int32)), pa.array(found), pa.array(ids[col])], names=["anchor", "w", "neg", "other"])

    return dealt.mapInArrow(run, "anchor long, w int, neg long, other long")


def searched(state: DataFrame, index: MultiIndex, members: DataFrame, need: int, first: int = FIRST) -> DataFrame:
    """``state`` after every anchor has found the first ``need`` rows of each of its windows."""
    rows = first
    while True:
        visits = stored(next_visits(state, index, rows, need), "visits")
        if visits.isEmpty():
            return state
        hits = seen(visits, members, index.width, need).unionByName(state.select("anchor", F.explode("best").alias("x")).select("anchor", "x.*"))
        best = hits.withColumn("at", F.row_number().over(Window.partitionBy("anchor", "w").orderBy("neg", "other"))).filter(F.col("at") <= need)
        best = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("w", "neg", "other"))).alias("best"))
        after = visits.groupBy("anchor").agg(F.max("after").alias("after"))
        moved = state.drop("best").withColumnRenamed("visited", "before").join(best, "anchor", "left").join(after, "anchor", "left")
        state = stored(moved.select(*STATE[:-2], F.coalesce("best", F.array().cast(FOUND)).alias("best"), F.coalesce("after", "before").alias("visited")), "anchors")
        rows *= GROWTH


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, most_codes: int = MOST_CODES, cell_rows: int = CELL, first: int = FIRST) -> DataFrame:
    """The hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``vectors`` has id (long), label (long) and v (whole numbers); ``is_anchor`` chooses anchors by them. A row's score is
    its inner product with the anchor, higher ones come first, ties by the smaller id. The positives are the first other
    rows of the anchor's label, the negatives of a positive the first rows of other labels with low * positive <= 100 *
    negative <= high * positive. Rows with a null id, label, vector or component take no part, nor do vectors with
    components beyond 2^25 or of more than 4,096 components, whose products 64 bits might not hold. Shorter vectors count
    as filled with zeros. Equal rows count once; other columns are not touched; no anchors give no rows.
    """
    keep = max(positives + 1, negatives)
    usable = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    usable = usable.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", lambda x: x.isNull() | (F.abs(x) > LARGEST)) & (F.size("v") <= LONGEST)).distinct()
    usable = stored(usable, "vectors")
    of_equal = Window.partitionBy("label", "v").orderBy("id")
    base = stored(usable.withColumn("at", F.row_number().over(of_equal)).filter(F.col("at") <= keep).drop("at"), "base")
    index, members = build(base, most_codes, cell_rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    members = stored(members, "members")
    nothing = F.array().cast(FOUND).alias("best")
    asked = usable.filter(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v")
    ends = [F.array(F.lit(-(1 << 62))).cast("array<long>").alias("low"), F.array(F.lit(1 << 62)).cast("array<long>").alias("high")]
    state = stored(asked.select("*", F.lit(True).alias("same"), *ends, nothing, F.lit(0).alias("visited")), "anchors")
    found = searched(state, index, members, positives, first)

    # a window of scores for each positive; the products need more than 64 bits
    edge = F.transform("best", lambda x: F.struct(F.ceil(-x["neg"].cast("decimal(20,0)") * low / 100).cast("long").alias("low"), F.floor(-x["neg"].cast("decimal(20,0)") * high / 100).cast("long").alias("high")))
    windows = found.filter(F.size("best") > 0).select("anchor", "id", "label", "v", F.lit(False).alias("same"), edge.alias("e"), F.col("best").alias("positives"))
    windows = stored(windows.select("anchor", "id", "label", "v", "same", F.col("e.low").alias("low"), F.col("e.high").alias("high"), nothing, F.lit(0).alias("visited"), "positives"), "windows")
    done = searched(windows.drop("positives"), index, members, negatives, first)
    pairs = windows.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("w", "p"))
    hits = done.select("anchor", F.explode("best").alias("x")).select("anchor", "x.*")
    out = pairs.join(hits, ["anchor", "w"]).select("anchor", "w", "anchor_id", F.col("p.other").alias("positive_id"), F.col("other").alias("negative_id"), (-F.col("p.neg")).alias("positive_score"), (-F.col("neg")).alias("negative_score"))
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.col("negative_score").desc(), "negative_id"))
    return out.withColumn("rank", rank).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector of ``embeddings``, some labels having been moved."""
    rows = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL").filter(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("v")), F.col("id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.anchor, p.id AS positive, n.id, p.score AS ps, n.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM pos p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE rank <= 5
"""
