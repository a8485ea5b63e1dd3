"""Verdicts by key as state of a stream: each asked row finds the last verdict of its key that still holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "key string, id long, ts timestamp, hit boolean, verdict string"
STATE = "keys array<string>, micros array<long>, ids array<long>, verdicts array<string>"
#: Groups that the keys are dealt out in: a call of Python costs some milliseconds, whatever it is for.
GROUPS = 512


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def held_verdicts(stream: DataFrame, hold: str, version: int, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """Every asked row of a stream with the verdict that held for its key: key, id, ts, hit, verdict.

    ``stream`` has key, id, ts, version and verdict; rows without a verdict ask, rows with one teach. A verdict of at
    least ``version`` holds for ``hold`` from its time on, or until the next one. The state of a key is its last verdict;
    once the watermark has passed the end of its hold a timer drops it, so that the state is as large as what holds. Rows
    of a batch are taken in order of ts and id; the stream's batches must come in order of time but for ``late``. Rows
    without a time or a key never meet the state: ``never_held`` answers them.

    Keys are dealt out in ``groups`` by their hash; the keys of one are a state and a timer, and one call for a batch.
    """
    micros = int(pd.Timedelta(hold) / pd.Timedelta(microseconds=1))
    dated = stream.filter("ts IS NOT NULL AND key IS NOT NULL").withWatermark("ts", late)

    def keep(state: GroupState, last: pd.DataFrame) -> None:
        mark = state.getCurrentWatermarkMs()
        last = last[(last["micros"] + micros) // 1000 > mark]
        if last.empty:
            if state.exists:
                state.remove()
            return
        state.update((last.index.tolist(), last["micros"].tolist(), last["ids"].tolist(), last["verdicts"].tolist()))
        # a timer must lie after the watermark
        state.setTimeoutTimestamp(max(int(last["micros"].min() + micros) // 1000, mark + 1))

    def walk(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, at, ids, verdicts = state.get if state.exists else ([], [], [], [])
        last = pd.DataFrame({"micros": pd.Series(at, dtype="int64"), "ids": pd.Series(ids, dtype="int64"), "verdicts": pd.Series(verdicts, dtype=object)}).set_axis(pd.Index(keys, dtype=object))
        if state.hasTimedOut:
            keep(state, last)
            return
        rows = pd.concat(list(parts)).sort_values(["key", "ts", "id"], kind="stable", ignore_index=True)
        at, ids, verdict = _micros(rows["ts"]).to_numpy(), rows["id"].to_numpy(dtype="int64"), rows["verdict"].to_numpy(dtype=object)
        asks = rows["verdict"].isna().to_numpy()
        key = rows["key"].to_numpy(dtype=object)
        begins = np.r_[True, key[1:] != key[:-1]]
        # the key's last verdict in the batch at or before each row, -1 if there is none, or the state's where that is later
        taught = np.maximum.accumulate(np.where(~asks & (rows["version"].to_numpy() >= version), np.arange(len(rows)), -1))
        taught = np.where(taught >= np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0)), taught, -1)
        place = last.index.get_indexer(key)
        of = lambda c, own, none: np.where(taught >= 0, own[taught], np.where(place >= 0, last[c].to_numpy()[place] if len(last) else none, none))
        if len(last):
            old_at, old_id = last["micros"].to_numpy()[place], last["ids"].to_numpy()[place]
            taught = np.where((place >= 0) & ((at[taught] < old_at) | ((at[taught] == old_at) & (ids[taught] < old_id))), -1, taught)
        known = (taught >= 0) | (place >= 0)
        since, by, told = of("micros", at, 0), of("ids", ids, 0), of("verdicts", verdict, None)
        holds = known & (since <= at) & (at - since < micros)
        ends = known & np.r_[begins[1:], True]
        fresh = pd.DataFrame({"micros": since[ends].astype("int64"), "ids": by[ends].astype("int64"), "verdicts": told[ends]}, index=pd.Index(key[ends], dtype=object))
        keep(state, pd.concat([last[~last.index.isin(fresh.index)], fresh]) if len(last) else fresh)
        yield pd.DataFrame({"key": key[asks], "id": ids[asks], "ts": rows["ts"].to_numpy()[asks], "hit": holds[asks], "verdict": np.where(holds, told, None)[asks]})

    return dated.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandasWithState(walk, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def never_held(rows: DataFrame) -> DataFrame:
    """The asked rows that no verdict can hold for, as they have no time or no key."""
    return rows.filter("(ts IS NULL OR key IS NULL) AND verdict IS NULL").select("key", "id", "ts", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("verdict"))


def held_verdicts_of(rows: DataFrame, hold: str, version: int) -> DataFrame:
    """The same over a whole table, by a window: the last verdict at or before each asked row."""
    taught = F.when(F.col("verdict").isNotNull() & (F.col("version") >= version), F.struct("ts", "verdict"))
    order = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    dated = rows.filter("ts IS NOT NULL AND key IS NOT NULL").withColumn("_last", F.last(taught, True).over(order)).filter("verdict IS NULL")
    holds = F.coalesce(F.unix_micros("ts") - F.unix_micros("_last.ts") < int(pd.Timedelta(hold) / pd.Timedelta(microseconds=1)), F.lit(False))
    return dated.select("key", "id", "ts", holds.alias("hit"), F.when(holds, F.col("_last.verdict")).alias("verdict")).unionByName(never_held(rows))
