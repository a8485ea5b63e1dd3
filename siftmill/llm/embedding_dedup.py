"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest reference points, the pivots, in order of nearness. Pivots are a sample in
which no two are near each other: a group of near copies, whatever its share of the rows, has about one, which all its
members name, so that they do not part by their own noise. Each pivot has inverted lists, one for each label, of the
vectors that name it. Vectors that meet in a list and share enough pivots are verified by their cosine. Lists are
compared block against block, a pair counts in the list of its least shared pivot only, and what leaves a block are
counts and the links of a spanning forest: no list is expanded into its pairs.

What the index finds is then measured: a bounded sample of vectors is held against all rows. Labels in which it has
missed links of these, as it does where the vectors have hardly more in common than any two of their label, are compared
exactly, all blocks of the label with all; so are small labels, of which a sample could tell nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.blocks import compared
from siftmill.llm.common import join_groups, stored, table
from siftmill.llm.components import components

NAMED = 10
LEAST_SHARED = 2
MOST_PIVOTS = 16_384
#: So many sampled vectors are looked at for each pivot.
SAMPLED = 4
#: So many vectors are held against all others of their label to measure the index.
QUERIES = 2_048
BLOCK = 512
#: Labels of up to so many different vectors are compared exactly, which costs less than an index.
SMALL = 2_048
#: Bytes of vectors that may come to the driver to choose pivots from or to measure the index by.
DRIVER_BYTES = 128 << 20
#: Cosines by a matrix product are summed anew where they are this close to the least one.
CLOSE = 1e-9


def n_pivots(n: int) -> int:
    """A power of two near four times the square root of the vectors, at least 16, at most MOST_PIVOTS."""
    return int(min(MOST_PIVOTS, max(16, 2 ** round(np.log2(4 * max(n, 1) ** 0.5)))))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; large components are scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spread(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """The first rows of length 1, at most ``most``, of which no two are within twice the angle of a link."""
    least = max(2 * cosine * cosine - 1, 0.5) if cosine > 0 else 0.5
    chosen = np.zeros((0, sample.shape[1]))
    for start in range(0, len(sample), 256):
        rows = sample[start : start + 256]
        rows = rows[~np.any(rows @ chosen.T >= least, axis=1)]
        near = rows @ rows.T >= least
        new: list[int] = []
        for k in range(len(rows)):
            if not near[k, new].any():
                new.append(k)
        chosen = np.vstack([chosen, rows[new]])
        if len(chosen) >= most:
            break
    return chosen[:most]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can be linked: a label, and a vector of finite components that are not all zero."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def matrix(v: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of so many columns, cut or filled with zeros, and their lengths."""
    rows = np.zeros((len(v), width))
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(v)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < width
    rows[owner[fits], place[fits]] = v.flatten().to_numpy(zero_copy_only=False)[fits]
    return rows, sizes


def described(classes: DataFrame, pivots: np.ndarray, named: int = NAMED) -> DataFrame:
    """``classes`` (id, label, v, copies) with the numbers of the nearest pivots, nearest first."""
    width, named = pivots.shape[1], min(named, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            rows, _ = matrix(batch.column("v"), width)
            near = np.where(np.any(rows, axis=1)[:, None], rows, 1.0)
            near = unit(near) @ pivots.T
            top = np.argpartition(-near, named - 1, axis=1)[:, :named]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, named, dtype=np.int32)), pa.array(top.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "named"])

    return classes.mapInArrow(run, "id long, label string, v array<double>, copies long, named array<int>")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the given links of numbers below ``n``: each part joins its least neighbour."""
    label = np.arange(n)
    a, b = [i[:0]], [j[:0]]
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        _, first = np.unique(high * n + low, return_index=True)
        first = first[np.unique(high[first], return_index=True)[1]]
        a.append(i[first])
        b.append(j[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while np.any(parent[parent] != parent):
            parent = parent[parent]
        label = parent[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return np.concatenate(a), np.concatenate(b)


def linked(v_a: np.ndarray, v_b: np.ndarray, least_cosine: float, good: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of length 1 with at least that cosine, of the good ones."""
    cosines = v_a @ v_b.T
    near = cosines >= least_cosine - CLOSE
    i, j = np.nonzero(near if good is None else near & good)
    keep = cosines[i, j] >= least_cosine + CLOSE
    close = np.flatnonzero(~keep)
    keep[close] = (v_a[i[close]] * v_b[j[close]]).sum(axis=1) >= least_cosine
    return i[keep], j[keep]


def block_links(least_cosine: float, least_shared: int):
    """Compares two blocks of a list: for each vector its links found here, and the links of a spanning forest.

    With ``least_shared`` of 0 the blocks are those of a whole label, and all pairs of them count.
    """

    def compare(left: dict, right: dict, same: bool) -> pa.RecordBatch | None:
        sides = []
        for s in (left, right):
            n = len(s["id"])
            sides.append((s["id"].to_numpy(), s["copies"].to_numpy(), unit(s["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1))))
        (id_a, n_a, v_a), (id_b, n_b, v_b) = sides
        good = np.ones((len(id_a), len(id_b)), dtype=bool)
        if least_shared:
            p_a, p_b = (s["named"].flatten().to_numpy(zero_copy_only=False).reshape(len(s["id"]), -1) for s in (left, right))
            numbers = np.unique(np.concatenate([p_a.reshape(-1), p_b.reshape(-1)]))
            names = [np.zeros((len(p), len(numbers)), dtype=np.float32) for p in (p_a, p_b)]
            for bits, p in zip(names, (p_a, p_b), strict=True):
                np.put_along_axis(bits, np.searchsorted(numbers, p), 1, axis=1)
            good = names[0] @ names[1].T >= least_shared
            before = int(np.searchsorted(numbers, left["pivot"][0].as_py()))  # a pair that shares a lesser pivot counts in that one's list
            if before:
                good &= names[0][:, :before] @ names[1][:, :before].T == 0
        if same:
            good &= np.triu(np.ones(good.shape, dtype=bool), 1)
        if not good.any():
            return None
        i, j = linked(v_a, v_b, least_cosine, good)
        links = np.r_[np.bincount(i, weights=n_b[j], minlength=len(id_a)), np.bincount(j, weights=n_a[i], minlength=len(id_b))].astype(np.int64)
        ids = np.r_[id_a, id_b]
        a, b = forest(i, j if same else j + len(id_a), len(ids))
        own = np.flatnonzero(links)
        nothing = [None] * len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([*ids[own].tolist(), *nothing], pa.int64()), pa.array([*links[own].tolist(), *nothing], pa.int64()), pa.array([None] * len(own) + ids[a].tolist(), pa.int64()), pa.array([None] * len(own) + ids[b].tolist(), pa.int64())],
            names=["id", "links", "a", "b"],
        )

    return compare


def by_hash(classes: DataFrame, salt: int, most: int) -> pa.Table:
    """At most so many of the classes, the first by a hash of the id, brought to the driver."""
    return classes.orderBy(F.xxhash64("id", F.lit(salt)), "id").select("id", "label", "v").limit(most).toArrow().combine_chunks()


def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table["v"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return matrix(v, int(max(v.value_lengths().to_pylist(), default=0)))


def missed(classes: DataFrame, counts: DataFrame, cosine: float, target: float, queries: int) -> DataFrame:
    """The (label, width) of which the index has found under ``target`` of the links of the sampled vectors.

    The sample is held against every row, task by task; what comes out of a task are its counts for each query.
    """
    chosen = by_hash(classes, 1, queries)
    rows, sizes = rows_of(chosen)
    ids = np.array(chosen["id"].to_pylist(), dtype=np.int64)
    groups: dict[tuple[str, int], list[int]] = {}
    for k, (label, size) in enumerate(zip(chosen["label"].to_pylist(), sizes.tolist(), strict=True)):
        groups.setdefault((label, size), []).append(k)
    asked = {(label, size): (ids[at], unit(rows[at][:, :size])) for (label, size), at in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in (part for whole in batches for part in slices(whole, 4096)):
            v = batch.column("v")
            labels, copies, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "copies", "id"))
            widths = v.value_lengths().to_numpy(zero_copy_only=False)
            places = pd.Series(np.arange(len(own))).groupby([labels.astype(object), widths]).indices
            for (label, size), at in places.items():
                if (label, size) in asked:
                    query_ids, query_rows = asked[label, size]
                    i, j = linked(unit(matrix(v.take(pa.array(at)), size)[0]), query_rows, cosine)
                    other = own[at][i] != query_ids[j]
                    for q, n in zip(query_ids[j[other]].tolist(), copies[at][i[other]].tolist(), strict=True):
                        total[q] = total.get(q, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    real = classes.select("id", "label", "v", "copies").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    held = F.broadcast(real).join(counts, "id", "left").join(classes.select("id", "label", F.size("v").alias("width")), "id")
    sums = held.groupBy("label", "width").agg(F.sum("n").alias("n"), F.sum(F.coalesce("links", F.lit(0))).alias("found"))
    return sums.filter(F.col("found") < F.col("n") * target).select("label", "width")


#: What comparing yields: a vector's links, or a link of a spanning forest.
LINKS = "id long, links long, a long, b long"


def links_of(found: DataFrame) -> DataFrame:
    """The links of each vector: id, links."""
    return found.filter("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))


def indexed_links(classes: DataFrame, most: int, sampled: int, cosine: float) -> DataFrame:
    """The links (LINKS) that the index finds. It is built from at most ``sampled`` vectors and holds all."""
    sample, _ = rows_of(by_hash(classes, 0, min(SAMPLED * most, sampled)))
    pivots = spread(unit(sample), most, cosine)
    index = stored(described(classes, pivots), "index")
    lists = stored(index.select("id", F.explode("named").alias("pivot"), F.xxhash64("label", F.size("v"), "pivot").alias("bucket")), "lists")
    sizes = stored(lists.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    members = join_groups(lists, sizes, ["bucket"], "n", lists.count()).join(index.select("id", "v", "copies", "named"), "id")
    return stored(compared(members, ["v", "copies", "named", "pivot"], block_links(cosine, min(LEAST_SHARED, len(pivots))), LINKS, block=BLOCK), "links")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, target: float = 0.99, queries: int = QUERIES, small: int = SMALL) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, their lengths are equal and their cosine in double
    precision reaches ``cosine``. Null vectors, zero vectors, vectors with null or non-finite components and rows without
    an id are linked with nothing and stay. Identical vectors are one class, compared once and counted as often as they
    occur. Ids are integers and must be unique; other columns are not touched; an empty table gives no rows. The pivots
    come from a bounded sample, every vector is indexed; of a group of near copies all pairs are compared, as all of
    them count. ``queries`` vectors measure the index: labels in which it has found under ``target`` of their links
    are then compared exactly, and so are those of at most ``small`` different vectors.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = usable(rows.filter("id IS NOT NULL"))
    classes = stored(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "label", "v", "copies"), "classes")
    total, width, n = classes.agg(F.sum("copies"), F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    per_driver = max(1, DRIVER_BYTES // (8 * width))
    found = indexed_links(classes, min(n_pivots(n), per_driver), per_driver, cosine)

    # An exact check follows: of labels that are small, so that no sample could measure each, and of those where the
    # sampled vectors show that the index has missed too many.
    weak = stored(missed(classes, links_of(found), cosine, target, min(queries, per_driver)), "missed")  # at most as many labels as queries
    sizes = stored(classes.groupBy("label", F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(F.broadcast(weak.withColumn("weak", F.lit(True))), ["label", "width"], "left").filter((F.col("n") <= small) | F.col("weak")).drop("weak"), "labels")
    if not sizes.isEmpty():
        exact = stored(join_groups(classes.withColumn("width", F.size("v")), sizes, ["label", "width"], "n", n).withColumn("bucket", F.xxhash64("label", "width")), "exact")
        every = stored(compared(exact, ["v", "copies"], block_links(cosine, 0), LINKS, block=BLOCK), "links")
        # the forest's links that the index has found there are true ones too, and may stay
        found = found.filter("id IS NULL").unionByName(found.filter("id IS NOT NULL").join(exact.select("id"), "id", "left_anti")).unionByName(every)

    counts = links_of(found)
    joined = components(found.filter("a IS NOT NULL").select("a", "b"))
    rep = classes.join(counts, "id", "left").join(joined, "id", "left")
    rep = rep.select("label", "v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = join_groups(good, rep, ["label", "v"], "copies", total).select("id", "n_links", "component_id")
    alone = rows.join(good.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and the smallest vector reachable by them."""
    return embedding_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
           WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT linked.b, reach.c FROM reach JOIN linked ON linked.a = reach.id WHERE reach.c < linked.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.c, m.vec_id) AS component_id, m.vec_id = coalesce(comp.c, m.vec_id) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) n ON n.a = m.vec_id LEFT JOIN comp ON comp.id = m.vec_id
"""
