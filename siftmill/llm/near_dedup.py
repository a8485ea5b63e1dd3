"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them.

Documents with the same set of shingles form a class and are compared once. A class's MinHash samples under many hash
functions give the keys of its bands; its MinHash samples under one hash function, the KEPT least hashes (all of a small
set), are folded into an odd sketch, a bitmap in which each sample flips one bit. The ones in the XOR of two sketches
tell how many samples differ, precisely so at high similarity. Every member of a band's bucket is first held against the
bucket's least and greatest member. Where a bucket then still holds several components, its members are compared block
against block by their sketches: first each with its closest match elsewhere, and then, for what is still apart, all
with all, so that no pair that shares a bucket and could matter is left out, and no bucket is expanded into its pairs.
Links are confirmed on whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.blocks import compared
from siftmill.llm.common import join_groups, stored, table
from siftmill.llm.components import components, merged

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
KEPT, SKETCH_BITS = 1024, 1024
#: Pairs are sifted out where their sketches differ by so many deviations more than at the similarity that links.
DEVIATIONS = 6.0
SHINGLE = 5
_draw = np.random.default_rng(20240521)
_MULTIPLY = (_draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_POWERS = (_draw.integers(0, 1 << 63, 32, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ROW_POWERS = (_draw.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mixer: every bit of the input moves half of the output's."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text.

    A-Z is lower-cased, words are runs outside [\\x20\\x09-\\x0D]. Texts with fewer words than a shingle have one, their
    whole sequence; texts without words, and nulls, have none.
    """
    words = [(t or "").encode("utf-8").lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
    whole = np.zeros(max(len(flat) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        whole += hashed[k : k + len(whole)] * _POWERS[k]
    whole = mix(whole)
    out, start = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(whole[start : start + n - width + 1]))
        elif n:
            out.append(mix((hashed[start : start + n] * _POWERS[:n]).sum(keepdims=True), n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start += n
    return out


def samples_of(sets: list[np.ndarray], at_once: int = 8192) -> np.ndarray:
    """MinHash samples, SAMPLES x sets; none of the sets may be empty."""
    found = np.full((SAMPLES, len(sets)), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    flat = np.concatenate(sets).astype(np.uint32) if sets else np.zeros(0, dtype=np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(flat), at_once):
        part, own = flat[lo : lo + at_once], owner[lo : lo + at_once]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least = np.minimum.reduceat(part[None, :] * _MULTIPLY + _ADD, starts, axis=1)
        found[:, own[starts]] = np.minimum(found[:, own[starts]], least)
    return found


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band, sets x BANDS; a key also says which band it is."""
    rows = samples.reshape(BANDS, ROWS, -1).astype(np.uint64)
    keys = mix((rows * _ROW_POWERS[:, :, None]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)[:, None])
    return np.ascontiguousarray(keys.T).view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmaps of the sets' KEPT least hashes, sets x SKETCH_BITS / 64."""
    kept = [s[:KEPT] for s in sets]  # sets are sorted
    owner = np.repeat(np.arange(len(kept)), [len(s) for s in kept])
    bit = (mix(np.concatenate(kept), 3) % np.uint64(SKETCH_BITS)).astype(np.int64) + owner * SKETCH_BITS
    parity = np.bincount(bit, minlength=len(kept) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.int64)


def most_ones(n_a, n_b, percent: int, least=np.minimum, greatest=np.maximum, exp=np.exp, root=np.sqrt):
    """The ones that the XOR of two linked sets' sketches stays below; for numbers, arrays or columns of set sizes."""
    shared = (n_a + n_b) * (percent / (100.0 + percent))
    rate = least(1.0 + 0 * n_a, KEPT / (greatest(n_a, n_b) + 0.0))
    common = shared * rate
    kept = least(n_a, KEPT + 0 * n_a) + least(n_b, KEPT + 0 * n_b)
    drawn = 2 * root(greatest(common * (1 - rate), 0 * common) * 0.25)
    differ = greatest(kept - 2 * common, 0 * common) + DEVIATIONS * drawn
    fade = exp(differ * (-4.0 / SKETCH_BITS))
    spread = root(greatest((1 - fade) * (SKETCH_BITS / 4) - differ * fade, 0 * fade))
    return (1 - exp(differ * (-2.0 / SKETCH_BITS))) * (SKETCH_BITS / 2) + DEVIATIONS * spread + 2


def portions(rows: list, size, most: int = 400_000) -> Iterator[slice]:
    """Consecutive slices of about so much size each."""
    start, total = 0, 0
    for i, row in enumerate(rows):
        total += size(row)
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(rows):
        yield slice(start, len(rows))


def _lists(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(values.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """id, n_shingles, a 128-bit digest of the set, its band keys and its odd sketch; docs has id (long) and text."""
    schema = "id long, n_shingles long, digest_a long, digest_b long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for part in portions(texts, lambda t: len(t or "")):
                sets = shingle_sets(texts[part], width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]
                samples = samples_of(full)
                sums = digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array(sizes), *map(pa.array, sums), _lists(band_keys(samples), BANDS), _lists(odd_sketches(full), SKETCH_BITS // 64)],
                    names=["id", "n_shingles", "digest_a", "digest_b", "bands", "sketch"],
                )

    return docs.select("id", "text").mapInArrow(run, schema)


def digests(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart; an empty one counts as a lone 0."""
    flat = np.concatenate([s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets])
    starts = np.r_[0, np.cumsum([max(len(s), 1) for s in sets])[:-1]]
    return [np.add.reduceat(mix(flat, salt), starts).view(np.int64) for salt in (1, 2)]


def set_table(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """id and the full shingle set of the text whose set has the wanted digest; docs has id, text, digest_a and digest_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            wanted = [batch.column(c).to_numpy() for c in ("digest_a", "digest_b")]
            for part in portions(texts, lambda t: len(t or "")):
                sets = shingle_sets(texts[part], width)
                own = np.flatnonzero(np.logical_and(*(d == w[part] for d, w in zip(digests(sets), wanted, strict=True))))
                sets = [sets[k].view(np.int64) for k in own]
                offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own + part.start)), lists], names=["id", "shingles"])

    return docs.select("id", "text", "digest_a", "digest_b").mapInArrow(run, "id long, shingles array<long>")


def alike(n_a: Column, n_b: Column, shared: Column, percent: int) -> Column:
    return shared * 100 >= (n_a + n_b - shared) * percent


def sifted(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose set sizes allow the similarity and whose sketches are close enough."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    ones = sum((F.bit_count(F.col("s_a")[k].bitwiseXOR(F.col("s_b")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    most = most_ones(F.col("n_a").cast("double"), F.col("n_b").cast("double"), percent, F.least, F.greatest, F.exp, F.sqrt)
    return both.filter(sizes & (ones <= most)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the similarity."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(alike(F.size("set_a"), F.size("set_b"), shared, percent)).select("a", "b")


def block_candidates(percent: int, closest: bool):
    """Compares two blocks by sketches: pairs of different components that are close enough, or each row's closest of those.

    A pair counts in the bucket of the first band that it shares and in no other.
    """

    def compare(left: dict, right: dict, same: bool) -> pa.RecordBatch | None:
        arrays = []
        for side in (left, right):
            sketch = side["sketch"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_BITS // 64)
            bands = side["bands"].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            arrays.append((side["id"].to_numpy(), side["component_id"].to_numpy(), side["n_shingles"].to_numpy(), sketch, bands))
        (id_a, comp_a, n_a, s_a, k_a), (id_b, comp_b, n_b, s_b, k_b) = arrays
        apart = comp_a[:, None] != comp_b[None, :]
        if not apart.any():
            return None
        ones = np.zeros(apart.shape, dtype=np.uint16)
        for k in range(s_a.shape[1]):
            ones += np.bitwise_count(s_a[:, k, None] ^ s_b[None, :, k])
        sizes = np.minimum(n_a[:, None], n_b[None, :]) * 100 >= np.maximum(n_a[:, None], n_b[None, :]) * percent
        good = apart & sizes & (ones <= most_ones(n_a[:, None].astype(float), n_b[None, :].astype(float), percent))
        if same:
            good &= np.triu(np.ones(good.shape, dtype=bool), 1)
        i, j = np.nonzero(good)
        shared = k_a[i] == k_b[j]
        good[i, j] = k_a[i, shared.argmax(axis=1)] == left["bucket"][0].as_py()
        if closest:
            far = np.where(good, ones, np.uint16(0xFFFF))
            best = np.zeros_like(good)
            best[np.arange(len(far)), far.argmin(axis=1)] = True
            best[far.argmin(axis=0), np.arange(far.shape[1])] = True
            good &= best
        i, j = np.nonzero(good)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(id_a[i], id_b[j])), pa.array(np.maximum(id_a[i], id_b[j]))], names=["a", "b"])

    return compare


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A shingle is ``width`` words, up to 32.

    Documents are linked when ``100 * shared >= percent * union`` holds for their sets of shingles; component_id is the
    smallest id reachable. Null, empty and blank texts have no shingles, are linked with nothing and stay. So do rows
    without an id, which no component can be named by: their component_id is null. Ids are integers. An id may come
    repeatedly, with one text or several: each row is linked by its own text, and a component is named by the least id of
    its rows, so that one id can name several. Other columns are not touched; an empty table gives no rows. MinHash misses a link of exactly 0.8
    that nothing else connects with a probability of about 1e-7.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_sigs = stored(signatures(docs, width), "signatures")
    digest = ["digest_a", "digest_b", "n_shingles"]
    full = all_sigs.filter("n_shingles > 0 AND id IS NOT NULL")
    total = full.count()
    # a class has a number of its own: its least id may be that of another class too
    classes = stored(full.groupBy(*digest).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "sets_seen")
    reps = stored(join_groups(full, classes, digest, "copies", total).filter("id = least").select(F.col("rep").alias("id"), "least", *digest, "bands", "sketch").dropDuplicates(["id"]), "classes")

    in_bands = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    shared = stored(join_groups(in_bands, stored(buckets, "bands"), ["bucket"], "n", BANDS * total), "buckets")
    wanted = reps.join(shared.select("id").distinct(), "id", "left_semi").select("id", "least", "digest_a", "digest_b")
    texts = docs.select(F.col("id").alias("least"), "text").join(wanted, "least")
    sets = stored(set_table(texts, width).dropDuplicates(["id"]), "sets")

    ends = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b"))))
    stars = shared.select(ends.alias("p")).select("p.a", "p.b").filter("a < b").distinct()
    links = stored(confirmed(sifted(stars, reps, percent), sets, percent), "stars")
    first = stored(merged(reps.select("id"), components(links)), "components")

    # A bucket of up to three members has all its pairs among the stars.
    large = shared.filter("n > 3").select("bucket", "n", "id")
    for closest in (True, False):
        members = large.join(first, "id")
        open_buckets = members.groupBy("bucket").agg(F.min("component_id").alias("c1"), F.max("component_id").alias("c2"), F.count(F.lit(1)).alias("n")).filter("c1 < c2").select("bucket", "n")
        rest = join_groups(members.drop("n"), stored(open_buckets, "open"), ["bucket"], "n", BANDS * total).join(reps.select("id", "n_shingles", "sketch", "bands"), "id")
        pairs = compared(rest, ["component_id", "n_shingles", "sketch", "bands"], block_candidates(percent, closest), "a long, b long").distinct()
        more = stored(confirmed(stored(pairs, "rest"), sets, percent), "more")
        side = lambda c: first.select(F.col("id").alias(c), F.col("component_id").alias(f"c_{c}"))  # noqa: E731,B023
        joined = components(more.join(side("a"), "a").join(side("b"), "b").select("c_a", "c_b"), "c_a", "c_b")
        found = first.join(joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("top")), "component_id", "left")
        first = stored(found.select("id", F.coalesce("top", "component_id").alias("component_id")), "components")
    members_of = classes.join(first.withColumnRenamed("id", "rep"), "rep")
    named = stored(members_of.groupBy("component_id").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("classes")), "names")
    members_of = join_groups(members_of, named, ["component_id"], "classes", classes.count())
    classed = members_of.select(*digest, "copies", F.col("name").alias("component_id"))
    classed = join_groups(full.select("id", *digest), stored(classed, "named"), digest, "copies", total).select("id", "n_shingles", "component_id")
    out = classed.unionByName(all_sigs.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document that it is linked with."""
    return near_dedup(table(spark, sf_dir, "documents"), width=4).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS s FROM w),
one AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
part AS (SELECT rep, len(s) AS n, unnest(s) AS sh FROM one),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM part a JOIN part b ON a.sh = b.sh AND a.rep < b.rep
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, c) AS (SELECT rep, rep FROM one UNION SELECT linked.b, reach.c FROM reach JOIN linked ON linked.a = reach.id WHERE reach.c < linked.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(comp.c, sets.doc_id) AS kept
FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) LEFT JOIN comp ON comp.id = one.rep
"""
