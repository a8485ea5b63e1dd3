"""Writing results: strict JSON, pools that put new rows first, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.survivorship import first_wins

CELL = 32_700


def finite(df: DataFrame) -> DataFrame:
    """``df`` with NaN and infinite numbers as null."""
    kinds = dict(df.dtypes)
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    return df.select(*[fix(c) if kinds[c] in ("double", "float") else c for c in df.columns])


def write_json(df: DataFrame, path: str) -> None:
    """Strict JSON lines: no NaN, nulls are written."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upserted(pool: DataFrame, new: DataFrame, key: str = "url", other: str = "row_id") -> DataFrame:
    """New rows before the pool's; the first of each url, else id, stays; rows with neither all stay."""
    both = new.withColumn("_batch", F.lit(0)).unionByName(pool.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    k = F.coalesce(F.nullif(F.col(key), F.lit("")), F.nullif(F.col(other).cast("string"), F.lit("")))
    return first_wins(both, k, [F.col("_batch"), F.col(other)]).drop("_batch")


def cell(column: str) -> Column:
    """A column as the text of a cell: no control characters, cut with a note where a cell would be too long."""
    clean = F.regexp_replace(F.col(column).cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.when(F.length(clean) > CELL, F.concat(F.substring(clean, 1, CELL), F.lit(" [cut]"))).otherwise(clean)


def export_cells(df: DataFrame) -> DataFrame:
    """Every column as the text of cells."""
    return df.select(*[cell(c).alias(c) for c in df.columns])
