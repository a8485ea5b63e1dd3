"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, component_id) for every id that a link names; component_id is the smallest id reachable.

    Each round lets every id join its least neighbour and contracts the graph, by the ids' own order and by a hash of
    them in turn: stars vanish in one round and long chains shrink by a constant share. Neither the links nor the
    components come to the driver. Null ends and links of a row with itself count for nothing.
    """
    edges = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links")
    kind = dict(edges.dtypes)["a"]
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.xxhash64(c, F.lit(len(parents)))) if len(parents) % 2 else F.col
        first = F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("id"))).alias("first")
        own = F.struct(rank("a").alias("rank"), F.col("a").alias("id"))
        parent = stored(both.groupBy("a").agg(first).select(F.col("a").alias("id"), F.least("first", own)["id"].alias("parent")), "parents")
        parents.append(parent)
        ends = edges.join(parent.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a").join(parent.select(F.col("id").alias("b"), F.col("parent").alias("pb")), "b")
        edges = stored(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(), "links")
    if not parents:
        return links.sparkSession.createDataFrame([], f"id {kind}, component_id {kind}")
    found = parents[0].select("id", F.col("parent").alias("top"))
    for parent in parents[1:]:
        step = parent.select(F.col("id").alias("top"), F.col("parent").alias("next"))
        found = found.join(step, "top", "left").select("id", F.coalesce("next", "top").alias("top"))
    if len(parents) == 1:  # by the ids' order every id has met the least of its component
        return found.select("id", F.col("top").alias("component_id"))
    found = stored(found, "tops")
    least = found.groupBy("top").agg(F.min("id").alias("component_id"))
    return found.join(least, "top").select("id", "component_id")


def merged(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (id) with the component_id of ``found``; an id that no link names is its own component."""
    return members.join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
