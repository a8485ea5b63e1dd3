"""Exact de-duplication by a stateful stream.

The state is keyed by the SHA-256 of the normalised text and kept on disk (RocksDB) without expiry. For each key it
holds the row to keep: its length, its stable identifier and its content locator, the file and the row in it that hold
the text. A hit on a key is never trusted: the rows behind it are read again at their locators and their full normalised
texts compared, and keys that turn out to hold several texts are split. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import SPACES, join_groups, join_small, scratch, stored, table

#: The state lives on disk; without pre-allocation, many small stores take the disk that their rows need.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def is_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of one Parquet relation: columns and conditions over a scan, nothing that
    repeats rows or draws them. Only then does a row's place in its file tell it from all others."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return False
    roots = plan.relation().location().rootPaths()
    return roots.distinct().size() == roots.size()  # a path given twice is read twice


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and locator of every row: file and row of a Parquet table, to which ``docs`` is written if it is no scan."""
    narrow = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    locator = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("locator")
    if is_scan(docs):
        try:
            return docs.select(*narrow, locator)
        except AnalysisException:  # a file format without row numbers, or columns that hide the scan's own
            pass
    return stored(docs.select(*narrow), "texts").select("id", "text", locator)


def fingerprints(texts: DataFrame, digest=None) -> DataFrame:
    """A narrow row per document: id, digest of the normalised text, code points of the original, content locator."""
    digest = digest or (lambda norm: F.sha2(norm, 256))
    return texts.select("id", digest(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), "locator")


def best() -> Column:
    """Orders copies: most code points first, then the smallest id, none last, then the locator."""
    return F.min(F.struct((-F.col("n_points")).alias("neg_points"), F.col("id").isNull().alias("no_id"), "id", "locator")).alias("best")


def arrive(stream: DataFrame, state_dir: str) -> DataFrame:
    """Runs the stream of fingerprints to its end and returns, for each digest, the row to keep and the rows seen.

    ``state_dir`` holds the stream's checkpoint and state; given again, only rows that came since are read. Each
    micro-batch writes the keys it changed under its own number, so that a repeated batch replaces its own output.
    Counts only grow and the best row only improves, so the last state of a key is its largest count and least best.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("seen"), best())
        changed = f"{state_dir}/changed"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{state_dir}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"digest string, seen long, best struct<neg_points: long, no_id: boolean, id: {dict(stream.dtypes)['id']}, locator: string>"
    log = spark.read.schema(schema).parquet(f"{changed}/batch=*")
    return log.groupBy("digest").agg(F.max("seen").alias("group_size"), F.min("best").alias("best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, batch_bytes: int = 8 << 30, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest, locator.

    Texts are equal when they are identical without white space; null counts as empty, so null, empty and blank texts
    are one group. Of equal texts the one with the most code points in the original stays, then the smallest id, a row
    without an id last; of rows that are alike in all of this the first by its locator. So one row of a group stays,
    repeated rows or not, and its keep_id is null only where no row of the group with as many code points has an id.
    Other columns of ``docs`` are not touched. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    path = scratch(spark, "fingerprints")
    source = located(docs, id_col, text_col)
    prints = fingerprints(source, digest)
    prints.write.parquet(path)
    log = spark.read.schema(prints.schema).parquet(path)
    total = log.count()
    if not total:
        return spark.createDataFrame([], f"id {kind}, keep_id {kind}, group_size long, kept boolean, digest string, locator string")
    reader = spark.readStream.schema(log.schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", batch_bytes)
    groups = stored(arrive(reader.parquet(path), scratch(spark, "arrivals")), "groups")

    # Hits: every row behind a digest seen more than once, read again where its locator says. Copies within a task meet
    # before the shuffle, so that a text with a third of all rows costs one row a task.
    hits = stored(join_groups(log, groups.filter("group_size > 1"), ["digest"], "group_size", total).select("id", "digest", "n_points", "locator"), "hits")
    at = stored(hits.select(F.xxhash64("locator").alias("at")).distinct(), "places")
    again = join_small(source.select("text", "locator", F.xxhash64("locator").alias("at")), at, ["at"], "left_semi", most=2_000_000)
    texts = again.select("locator", normalised(F.col("text")).alias("norm")).join(hits, "locator")
    distinct = texts.groupBy("digest", F.xxhash64("norm").alias("h"), "norm").agg(F.count(F.lit(1)).alias("group_size"), best())
    mixed = stored(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "mixed")

    names = ["id", "keep_id", "group_size", "digest", "locator", "keep_at"]
    verdict = [F.col("best.id").alias("keep_id"), "group_size", F.col("best.locator").alias("keep_at")]
    plain = join_groups(log, groups, ["digest"], "group_size", total).select("id", "digest", "locator", *verdict).select(*names)
    if not mixed.isEmpty():  # one digest, several texts: those groups are formed by the texts themselves
        split = distinct.join(mixed, "digest").select("digest", "norm", *verdict)
        exact = texts.select("id", "digest", "norm", "locator").join(split, ["digest", "norm"]).select(*names)
        plain = plain.join(mixed, "digest", "left_anti").select(*names).unionByName(exact)
    return plain.select("id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), "digest", "locator")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    return exact_dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
