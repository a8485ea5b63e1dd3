"""Packing documents into sequences of a fixed number of tokens by conflict-constrained best fit.

Documents are dealt evenly into shards, each of which packs its own bins. A document longer than a sequence fills whole
sequences with its front; what is left of it is packed. Open bins are ordered by what they have left, and each carries
bitmaps of the sources and of the duplicate clusters in it. A document, longest first, goes into the tightest bin that
holds it and with which it does not conflict: the search starts at the bins that it would fill and goes on to the next
larger ones until one is compatible; if none is, a bin is opened.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import SPACES, stored, table
from siftmill.llm.token_counts import VOCABULARY, token_counter

CAPACITY = 2048
SHARD_ROWS = 8192


def bits_of(values: pd.Series) -> list[int]:
    """A bit for every value that occurs more than once; other values, and nulls, cannot conflict: 0."""
    counts = values.value_counts()
    number = {v: 1 << k for k, v in enumerate(sorted(counts.index[counts > 1]))}
    return [number.get(v, 0) for v in values]


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each item; sizes come in falling order and none exceeds the capacity."""
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set where by_left[r] has bins
    left: list[int] = []
    held: list[tuple[int, int]] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        chosen = -1
        larger = some >> size << size
        while larger and chosen < 0:
            room = (larger & -larger).bit_length() - 1
            for b in by_left[room]:
                if not (held[b][0] & source or held[b][1] & cluster):
                    chosen = b
                    break
            larger &= larger - 1
        if chosen < 0:
            chosen, room = len(left), capacity
            left.append(capacity)
            held.append((0, 0))
        else:
            by_left[room].remove(chosen)
            if not by_left[room]:
                some &= ~(1 << room)
        bins.append(chosen)
        offsets.append(capacity - room)
        left[chosen] = room - size
        held[chosen] = (held[chosen][0] | source, held[chosen][1] | cluster)
        if left[chosen]:
            by_left[left[chosen]].append(chosen)
            some |= 1 << left[chosen]
    return bins, offsets


def packed(docs: DataFrame, n_tokens, cluster, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per piece of a document: doc_id, source, piece, start, n_tokens, bin_id, bin_offset.

    ``n_tokens`` and ``cluster`` are columns: a row's length, and the cluster of duplicates of which a bin takes one
    row. Of a source a bin takes one row too, however large the source: where it leaves no compatible bin, one is
    opened. Null clusters and null sources never conflict. Rows of no tokens need no room: one piece, no bin. Repeated rows are
    packed each. ``start`` is the piece's first token in its document, ``bin_offset`` its place in the bin. Other
    columns are not carried; no rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), n_tokens.cast("long").alias("total"), F.monotonically_increasing_id().alias("row_no"))
    rows = stored(rows, "lengths")  # row numbers stay as written, whatever is computed again
    tails = rows.withColumns({"piece": F.floor(F.col("total") / capacity), "start": F.col("total") - F.col("total") % capacity, "n_tokens": F.col("total") % capacity})
    to_pack = tails.filter("n_tokens > 0")
    shards = max(1, -(-to_pack.count() // shard_rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "row_no"], ascending=[False, True], kind="stable", ignore_index=True)
        sources, clusters = bits_of(group["source"]), bits_of(group["cluster"])
        bins, offsets = best_fit(group["n_tokens"].tolist(), sources, clusters, capacity)
        group["bin_id"] = [f"{s}-{b}" for s, b in zip(group["shard"], bins, strict=True)]
        group["bin_offset"] = offsets
        return group[["doc_id", "source", "piece", "start", "n_tokens", "bin_id", "bin_offset"]]

    schema = f"doc_id {kind}, source string, piece long, start long, n_tokens long, bin_id string, bin_offset long"
    tail = to_pack.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards))).groupBy("shard").applyInPandas(pack, schema)
    full = rows.filter(F.col("total") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / capacity) - 1)))
    full = full.select("doc_id", "source", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "row_no", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    nothing = rows.filter("coalesce(total, 0) = 0").select("doc_id", "source", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return tail.unionByName(full).unionByName(nothing)


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) packed by their tokens; copies of a text without white space are a cluster."""
    cluster = F.xxhash64(F.translate(F.coalesce("text", F.lit("")), SPACES, ""))
    return packed(docs, token_counter(public_tokenizers.path(VOCABULARY))(F.col("text")), cluster)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packed_texts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
