"""What a log of events says: runs, what was learned and is still true, settings that mean the same, batches by size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.dates import let
from siftmill.tables import stored


def runs(events: DataFrame, key: str, time: str, gap: str, **totals: Column) -> DataFrame:
    """Runs of a key's events that lie at most ``gap`` apart: key, started, ended, events, ``totals``, and ago, 1 for the
    latest run, 2 for the one before it.

    Events without a time are in no run, those without a key are one key. A run's events are added up before they are
    shuffled, and a hot key's runs meet as one row each.
    """
    dated = events.filter(F.col(time).isNotNull())
    window = F.session_window(F.col(time), gap)
    found = dated.groupBy(F.col(key), window.alias("_w")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("events"), *[c.alias(name) for name, c in totals.items()])
    return found.drop("_w").withColumn("ago", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("started"))))


def remembered(log: DataFrame, key: str, value: str, version: str, order: list[str], least_version: int) -> DataFrame:
    """The entries of a log that change what is known of a key, and whether each is the one that holds now.

    Entries of an older version than ``least_version`` are skipped as if they had never been; an entry whose value is the
    one before it is not written; an empty or null value deletes, and is written only where there is something to delete.
    """
    valid = log.filter(F.col(version) >= least_version).withColumn("_v", F.coalesce(F.col(value), F.lit("")))
    by_key = Window.partitionBy(key).orderBy(*order)
    changed = valid.withColumn("_before", F.coalesce(F.lag("_v").over(by_key), F.lit(""))).filter("_v <> _before")
    last = F.lead("_v").over(by_key).isNull()
    return changed.withColumn("holds", last & (F.col("_v") != "")).drop("_v", "_before")


def canonical(settings: Column, depth: int = 3) -> Column:
    """A VARIANT as a text that is the same whenever the value means the same.

    Objects are written by their keys in order, without those that are null, blank or empty; arrays are sets: sorted,
    without repeats and blanks; numbers and texts are what they display as, trimmed. So are values nested deeper than
    ``depth``, where the order inside arrays counts. Null and empty values are the empty text.
    """
    return let(settings, lambda s: _canonical(s, depth))


def _canonical(settings: Column, depth: int) -> Column:
    # inside functions of arrays Spark computes what is written twice twice, and so twice again at every level
    quoted = lambda t: F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    plain = F.trim(F.coalesce(F.try_variant_get(settings, "$", "string"), F.lit("")))
    text = let(plain, lambda p: F.when(p == "", p).otherwise(quoted(p)))
    if depth == 0:
        return text
    wrapped = lambda parts, a, b: let(F.array_join(parts, ","), lambda p: F.when(p == "", p).otherwise(F.concat(F.lit(a), p, F.lit(b))))
    below = lambda v: canonical(v, depth - 1)

    def fields(entries: Column) -> Column:
        told = F.filter(F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("k"), below(e["value"]).alias("v"))), lambda e: e["v"] != "")
        return wrapped(F.transform(F.array_sort(told), lambda e: F.concat(quoted(e["k"]), F.lit("="), e["v"])), "{", "}")

    def items(values: Column) -> Column:
        return wrapped(F.array_sort(F.array_distinct(F.filter(F.transform(values, below), lambda t: t != ""))), "[", "]")

    # only an object can be read as a map, and only an array as an array
    other = let(F.try_variant_get(settings, "$", "array<variant>"), lambda a: F.when(a.isNotNull(), items(a)).otherwise(text))
    return let(F.try_variant_get(settings, "$", "map<string, variant>"), lambda m: F.when(m.isNotNull(), fields(m)).otherwise(other))


def batched(rows: DataFrame, size: Column, key: str, budget: int, shares: int = 64) -> DataFrame:
    """``rows`` with a batch: rows of one batch come from one value of ``key`` and have at most ``budget`` together, or are
    one row that is larger.

    A key is dealt into shares by a hash of the row, so that a hot one is many tasks; within a share rows are filled in
    order: a row that passes a multiple of the budget begins the next batch.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(shares))
    order = Window.partitionBy(key, "_share").orderBy("id")
    sized = rows.withColumns({"_share": share, "_size": size})
    # half of the budget is a step: what lies in one step and what passes into the next have no more than the whole
    running = sized.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.floor((F.col("_end") - F.col("_size")) / F.greatest(F.lit(budget // 2), F.lit(1)))
    large = F.col("_size") * 2 > budget
    batch = F.concat_ws("/", F.col(key).cast("string"), "_share", F.when(large, F.concat(F.lit("row "), F.col("id").cast("string"))).otherwise(step.cast("string")))
    return running.withColumn("batch", batch).drop("_share", "_size", "_end")


def reviewed(rows: DataFrame, review: Callable[[pd.DataFrame], list[tuple[int, str]]], most_rounds: int = 20) -> DataFrame:
    """id and answer of every row, whatever fails: the answer, or ``failed``.

    ``rows`` has id, text and batch. A batch is put to ``review``, which returns (id, answer) pairs or raises; an answer to
    an id that was not asked counts for nothing, an id answered twice or not at all is open. Open rows are asked again in
    halves of their batch, each round in parallel, until they are answered or alone and still open.
    """
    open_, answers = rows.select("id", "text", "batch"), None

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        try:
            told = list(review(group[["id", "text"]]))
        except Exception:  # noqa: BLE001 a reviewer that fails is what this is for
            told = []
        times = Counter(i for i, _ in told)
        known = {i: a for i, a in told if times[i] == 1}
        return pd.DataFrame({"id": group["id"], "answer": pd.Series([known.get(i) for i in group["id"]], index=group.index, dtype=object), "alone": len(group) == 1})

    for _ in range(most_rounds):
        told = stored(open_.groupBy("batch").applyInPandas(answer, f"id {dict(rows.dtypes)['id']}, answer string, alone boolean"), "answers")
        done = told.filter("answer IS NOT NULL OR alone").select("id", F.coalesce("answer", F.lit("failed")).alias("answer"))
        answers = done if answers is None else answers.unionByName(done)
        left = told.filter("answer IS NULL AND NOT alone").select("id")
        if left.isEmpty():
            return answers
        half = F.ntile(2).over(Window.partitionBy("batch").orderBy("id"))
        open_ = stored(open_.join(left, "id", "left_semi").withColumn("batch", F.concat_ws(".", "batch", half)), "open")
    return answers.unionByName(open_.select("id", F.lit("failed").alias("answer")))
