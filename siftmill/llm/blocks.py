"""Comparing the members of buckets block against block, in cells of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
STRIPE = 4


def compared(members: DataFrame, columns: list[str], compare: Callable, schema: str, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """Calls ``compare(left, right, same)`` for every pair of blocks of a bucket and returns the rows it yields.

    ``members`` has bucket, n (the bucket's rows), id and ``columns``. A bucket is dealt by a hash of the id into blocks
    of about ``block`` rows, ``stripe`` blocks are a stripe, and two stripes of a bucket (or one with itself) are a cell.
    A row travels once for each cell that it is in, as many times as its bucket has stripes; a cell of at most
    2 * stripe * block rows or so is a row of the shuffled table, so that a bucket of any size is spread over all
    tasks. Left and right are dicts of Arrow arrays; ``same`` tells that a block meets itself. compare returns an Arrow
    record batch or None.
    """
    blocks = F.ceil(F.col("n") / block)
    part = F.pmod(F.xxhash64("id"), blocks)
    names = ["id", *columns]
    dealt = members.select("bucket", part.alias("part"), F.floor(part / stripe).alias("own"), F.ceil(blocks / stripe).alias("stripes"), *names)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    keys = ["bucket", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj")]
    cells = dealt.select(*keys, F.struct("part", F.lit(stripe).alias("stripe"), *[c for c in names if c != "bucket"]).alias("m"))
    # an explicit number of partitions: cells cost far more than their bytes tell, so they must not be put together by size
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, "bucket", "ci", "cj").groupBy("bucket", "ci", "cj").agg(F.collect_list("m").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, ci, cj = (batch.column(k)[row].as_py() for k in range(3))
                for left, right, same in block_pairs(batch.column(3)[row].values, ci, cj):
                    for side in (left, right):
                        side["bucket"] = pa.array([bucket])
                    out = compare(left, right, same)
                    if out is not None and out.num_rows:
                        yield out

    return cells.mapInArrow(run, schema)


def block_pairs(rows: pa.StructArray, ci: int, cj: int) -> Iterator[tuple[dict, dict, bool]]:
    """The pairs of blocks of a cell: those of one stripe with those of the other, each pair once."""
    part = rows.field("part").to_numpy()
    stripe = rows.field("stripe")[0].as_py()
    order = np.argsort(part, kind="stable")
    numbers, starts = np.unique(part[order], return_index=True)
    ends = np.r_[starts[1:], len(part)]
    names = [f.name for f in rows.type if f.name not in ("part", "stripe")]
    if len(numbers) == 1:
        blocks = [{c: rows.field(c) for c in names}]
    else:
        blocks = [{c: column.take(pa.array(order[s:e])) for c, column in ((c, rows.field(c)) for c in names)} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    of_stripe = [(k, int(k) // stripe, b) for k, b in zip(numbers.tolist(), blocks, strict=True)]
    for i, si, left in of_stripe:
        for j, sj, right in of_stripe:
            if i <= j and (si, sj) == (ci, cj):
                yield dict(left), dict(right), i == j
