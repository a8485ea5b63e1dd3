"""What the operators of this subpackage share. Python functions take Arrow batches, which Spark bounds at 64 MB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.tables import scratch_path as scratch
from siftmill.tables import stored, table

__all__ = ["SPACES", "free_name", "held_out", "join_groups", "join_small", "scratch", "stored", "table"]

#: The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` joined to the one row that ``groups`` has for their keys, whatever share of the rows a key holds.

    ``size`` counts the rows of a group and ``total`` all rows, so that at most ``parts`` groups hold over 1 / parts of
    them: those few are broadcast, and only keys below that share are dealt out by a shuffle.
    """
    hot = F.col(size) * parts > total
    large, small = groups.filter(hot), groups.filter(~hot)
    with_large = rows.join(F.broadcast(large), keys)
    with_small = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys)
    return with_large.unionByName(with_small)


def join_small(rows: DataFrame, few: DataFrame, keys: list[str], how: str, most: int = 500_000) -> DataFrame:
    """``rows`` joined to narrow rows that are mostly few: broadcast where they are counted to be at most ``most``, so that
    ``rows`` need not move, else shuffled. ``few`` is a stored table."""
    return rows.join(F.broadcast(few) if few.count() <= most else few, keys, how)
