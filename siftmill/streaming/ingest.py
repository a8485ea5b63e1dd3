"""Collecting postings as a stream: each key's first row stays, whatever comes later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Rows whose key has not come before within the watermark. Rows without a time would be lost to it: they go a way of
    their own, ``without_time``, and ``with_undated`` puts them to what was collected."""
    dated = stream.filter(F.col(time).isNotNull()).withWatermark(time, late)
    return dated.dropDuplicatesWithinWatermark([key])


def without_time(stream: DataFrame, time: str) -> DataFrame:
    """Rows that a watermark would drop."""
    return stream.filter(F.col(time).isNull())


def with_undated(collected: DataFrame, arrived: DataFrame, key: str, time: str) -> DataFrame:
    """What a stream has collected, and of the arrived rows without a time one for each key that it lacks."""
    undated = without_time(arrived, time).dropDuplicates([key])
    return collected.select(*arrived.columns).unionByName(undated.join(collected.select(key), key, "left_anti").select(*arrived.columns))


def collect_into(stream: DataFrame, table_folder: str, state_folder: str, transform=lambda df: df) -> StreamingQuery:
    """Runs what has arrived through ``transform``, batch by batch; a repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{table_folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state_folder).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Rows by hour and key, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), key).agg(F.count(F.lit(1)).alias("n"))
