"""Places in an order of all rows, counted range by range so that no task holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.tables import stored


def placed(rows: DataFrame, order: list[Column | str], keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in an order, or within the rows of the same ``keys``; nulls are a key too.

    Rows are dealt into ranges of keys and order that Spark cuts by a sample of them, so that neither an outlier nor a
    value with very many rows makes one range large; they are stored before, as the sample would else compute them once
    more. Each range is numbered by itself, and the sizes of those before it are
    added. There are as many sizes as ranges and keys, which are few.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(stored(rows, "unplaced").repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(sizes, same).withColumn("place", F.col("_before") + F.col("_i")).select(*rows.columns, "place")


def placed_within(rows: DataFrame, keys: list[str], by: str, last: str) -> DataFrame:
    """``rows`` with their place within the rows of the same ``keys``, by a number ``by`` (none last), then ``last``."""
    return placed(rows, [F.asc_nulls_last(by), F.col(last)], tuple(keys)).withColumn("place", F.col("place").cast("int"))
