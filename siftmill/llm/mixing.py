"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that each of its documents has to occur for the sources to have their target
weights. A document's count is drawn by inverting the Poisson distribution of that mean at a number hashed from a seed
and the document, so that every run and every retry draws the same. Documents are repeated by their counts and put into
an order that is random over the whole table. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import join_groups, stored, table

#: Larger means are drawn as sums of parts, each of a mean up to this, where all but 2**-80 of the mass lies below TERMS.
PART = 16.0
TERMS = 80
DIGITS = 13


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float] | None, other: float, total: float | None) -> DataFrame:
    """One row per source: its rows and the rate that gives it its share of ``total`` rows (as many as there are if None)."""
    counts = docs.groupBy("mix_source").agg(F.count(F.lit(1)).alias("mix_rows"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("mix_source")].cast("double"), F.lit(float(other))) if weights else F.lit(float(other))
    weighed = counts.withColumn("w", weight)
    whole = weighed.agg(F.sum("w").alias("all_w"), F.sum("mix_rows").alias("all_rows"))
    rate = F.coalesce(F.col("w") / F.col("all_w") * (F.lit(float(total)) if total else F.col("all_rows")) / F.col("mix_rows"), F.lit(0.0))
    return weighed.join(F.broadcast(whole)).select("mix_source", "mix_rows", rate.alias("mix_rate"))


def with_tables(found: DataFrame) -> DataFrame:
    """Each rate with the number of its parts and the cumulated probabilities of a part."""
    parts = F.greatest(F.ceil(F.col("mix_rate") / PART), F.lit(1)).cast("int")
    mean = F.col("mix_rate") / F.col("mix_parts")
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    grow = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"))
    return found.withColumn("mix_parts", parts).withColumn("mix_cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, grow, lambda s: s["c"]))


def in_order(rows: DataFrame, place: str) -> DataFrame:
    """``rows`` in the order of a hexadecimal hash: its even distribution gives the partitions their ranges, unsampled."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.conv(F.substring(place, 1, 8), 16, 10).cast("long")
    return rows.repartitionById(tasks, F.floor(share * tasks / F.lit(1 << 32)).cast("int")).sortWithinPartitions(place)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` repeated to the target weights and shuffled; adds rate, n_copies, copy_no and place.

    ``weights`` gives sources' weights, sources not in it have ``other``; the weights' ratio is that of the expected
    rows. Null sources are one source with the empty one. A document that draws 0 does not occur. Rows with the same id,
    and rows without one, draw the same count each. ``place`` is the hash that orders the result; columns of these four
    names are replaced, all others are carried. No rows give no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("rate", "n_copies", "copy_no", "place")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("mix_doc"), F.col(id_col).cast("string").alias("mix_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"))
    known = stored(with_tables(rates(keyed, weights, other, total)), "rates")
    n = known.agg(F.coalesce(F.sum("mix_rows"), F.lit(0)).alias("n")).first()["n"]
    drawn = join_groups(keyed, known, ["mix_source"], "mix_rows", n)
    below = lambda j: F.size(F.filter("mix_cdf", lambda c: c <= uniform(seed, F.col("mix_id"), j)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0), lambda a, j: a + below(j))
    copies = drawn.withColumn("n_copies", count).filter("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}p"), "mix_id", F.col("copy_no").cast("string")), 256), 1, 16)
    out = copies.select("mix_doc.*", F.col("mix_rate").alias("rate"), "n_copies", "copy_no", place.alias("place"))
    return in_order(out, "place")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repetition of every document in a mixture that gives each source the same weight.

    The mixture itself, whole documents repeated and in order, is written to the shared folder; its rows are returned
    without their texts, in its order.
    """
    out = stored(mixed(table(spark, sf_dir, "documents")), "mixture")
    return in_order(out.select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("n_copies").cast("long").alias("n_copies"), F.col("copy_no").cast("long").alias("copy_no"), "place"), "place")


ORACLE = """
WITH s AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, 1.0::DOUBLE / (SELECT count(*) FROM s) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
m AS (SELECT src, rate, greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS parts FROM r),
c AS (SELECT src, rate, parts, list_transform(range(0, 81), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate / parts) * pow(rate / parts, i) / gamma(i + 1)))) AS cdf FROM m),
u AS (SELECT doc_id, source, rate, cdf, unnest(range(1, parts + 1)) AS j FROM documents JOIN c ON c.src = coalesce(source, '')),
k AS (SELECT doc_id, source, rate, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(sha256('17:' || doc_id || ':' || j), 1, 13))::BIGINT / pow(16.0::DOUBLE, 13)))) AS n FROM u GROUP BY ALL),
e AS (SELECT doc_id, source, rate, n, unnest(range(1, n::BIGINT + 1)) AS copy_no FROM k)
SELECT doc_id, source, round(rate, 9) AS rate, CAST(n AS BIGINT) AS n_copies, copy_no, substr(sha256('17p:' || doc_id || ':' || copy_no), 1, 16) AS place FROM e
"""
