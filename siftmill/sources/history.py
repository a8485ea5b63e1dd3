"""Tables with a history: commits of changed rows, read together when the table is read.

A table is a folder with data files of the changes and a log with one small file a version. A commit writes its changes
first and its log entry last, under a name that no other commit can take: what has no entry is unseen, and of two writers
one fails. A row of a change puts or deletes a key; the last change of a key up to a version is what that version holds.
Merging costs the rows that change, reading adds up changes, and ``compact`` writes a version as a snapshot, before which
nothing need be read. Files go through the file system that the folder's address names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.tables import stored


class Conflict(RuntimeError):
    """Another commit has taken the version."""


class Folder:
    """Small files of a folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        where = self.at(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file whole or not at all; one that exists is never replaced."""
        draft, final = self.at(f"_draft-{uuid.uuid4().hex}"), self.at(name)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(final.getParent())
        # an exclusive create first: some file systems let a rename replace what is there
        try:
            self.fs.create(self.at(f"{name}.lock"), False).close()
        except Exception as taken:
            self.fs.delete(draft, False)
            raise Conflict(name) from taken
        if not self.fs.rename(draft, final):
            raise Conflict(name)


class History:
    """A table with a key, changed by commits and read as of any of them."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.folder, self.key = spark, Folder(spark, path), key
        self.empty = spark.createDataFrame([], schema)
        self.schema = self.empty.schema

    def log(self) -> list[dict]:
        """The commits in order: version, data, kind (changes or snapshot) and note."""
        return [json.loads(self.folder.read(f"log/{name}")) for name in self.folder.names("log") if name.endswith(".json")]

    def version(self) -> int:
        return max((c["version"] for c in self.log()), default=0)

    def _commit(self, rows: DataFrame, kind: str, note: str, after: int) -> int:
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{data}")
        number = after + 1
        self.folder.create(f"log/{number:012d}.json", json.dumps({"version": number, "data": data, "kind": kind, "note": note}))
        return number

    def changes(self, version: int | None = None, since: int = 0) -> DataFrame:
        """The changed rows of the commits after ``since`` up to a version: the columns, _version and _gone."""
        columns = [F.col(c) for c in self.schema.names]
        out = self.empty.select(*columns, F.lit(0).alias("_version"), F.lit(False).alias("_gone"))
        for c in self.log():
            if since < c["version"] and (version is None or c["version"] <= version):
                out = out.unionByName(self.spark.read.schema(self._stored_schema()).parquet(f"{self.folder.path}/{c['data']}").select(*columns, F.lit(c["version"]).alias("_version"), "_gone"))
        return out

    def _stored_schema(self):
        return self.empty.select("*", F.lit(False).alias("_gone")).schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the latest if none is given; version 0 is empty."""
        entries = [c for c in self.log() if version is None or c["version"] <= version]
        base = max((c["version"] for c in entries if c["kind"] == "snapshot"), default=1)
        rows = self.changes(version, since=base - 1)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names, "_gone"), "_version").alias("_row"))
        return last.filter("NOT _row._gone").select(*[F.col(f"_row.`{c}`").alias(c) for c in self.schema.names])

    def merge(self, source: DataFrame, update: dict[str, Column] | None = None, insert: bool = True, delete: Column | None = None, keep: Column | None = None, delete_missing: bool = False, note: str = "") -> int:
        """Merges ``source`` (the table's columns, at most one row a key) into the latest version and returns the new one.

        In conditions and values the table's columns are ``old.x`` and the source's ``new.x``. A key that both have is
        deleted where ``delete`` holds, left as it is where ``keep`` holds, and else updated: to the source's row, or only
        in the columns of ``update``. A key of the source alone is inserted unless ``delete`` holds; one of the table
        alone is deleted with ``delete_missing``. Keys that are null are never merged and an error in the source, as are
        keys that come twice. Rows that would not change are not written.
        """
        now = self.version()
        source = stored(source.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]), "source")
        if not source.filter(F.col(self.key).isNull()).isEmpty() or not source.groupBy(self.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{self.key} must be there and be different in every row")
        old = self.read(now).select(F.col(self.key).alias("_k"), F.struct(*self.schema.names).alias("old"))
        new = source.select(F.col(self.key).alias("_n"), F.struct(*self.schema.names).alias("new"))
        both = old.join(new, F.col("_k") == F.col("_n"), "full")
        in_old, in_new = F.col("_k").isNotNull(), F.col("_n").isNotNull()
        gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
        stays = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
        value = {c: F.col(f"new.`{c}`") if update is None else (update or {}).get(c, F.col(f"old.`{c}`")) for c in self.schema.names}
        value[self.key] = F.coalesce("_k", "_n")
        row = F.when(in_old & in_new, F.struct(*[value[c].cast(self.schema[c].dataType).alias(c) for c in self.schema.names])).otherwise(F.coalesce("new", "old"))
        leaves = (in_old & in_new & gone) | (in_old & ~in_new & F.lit(delete_missing))
        writes = (in_new & ~in_old & F.lit(insert) & ~gone) | (in_old & in_new & ~gone & ~stays)
        changed = both.filter(leaves | writes).withColumn("_row", row).withColumn("_gone", leaves)
        changed = changed.filter(F.col("_gone") | ~F.col("_row").eqNullSafe(F.col("old")))
        return self._commit(changed.select("_row.*", "_gone"), "changes", note, now)

    def put(self, rows: DataFrame, note: str = "") -> int:
        return self.merge(rows, note=note)

    def delete(self, keys: DataFrame, note: str = "") -> int:
        """Deletes the keys that ``keys`` has."""
        now = self.version()
        gone = self.read(now).join(keys.select(self.key).distinct(), self.key, "left_semi")
        return self._commit(gone.select(*self.schema.names, F.lit(True).alias("_gone")), "changes", note, now)

    def clear(self, note: str = "") -> int:
        now = self.version()
        return self._commit(self.empty.select("*", F.lit(True).alias("_gone")), "snapshot", note, now)

    def compact(self) -> int:
        """The latest version as a snapshot of its own; earlier versions can still be read."""
        now = self.version()
        return self._commit(self.read(now).select("*", F.lit(False).alias("_gone")), "snapshot", "compacted", now)


def resumed(spark: SparkSession, path: str, start: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], until: str | None = None) -> tuple[DataFrame, list[str]]:
    """Runs named stages one after another, each on what the one before has stored, and returns the last table and the
    names of those that ran.

    A stage is done once its marker stands beside its table; given the same folder again, stages that are done are not
    run, and a stage that was interrupted is run anew into a folder of its own. The order of the stages is part of their
    markers: after a stage that is new or moved nothing counts as done.
    """
    folder, rows, ran, fresh = Folder(spark, path), start, [], True
    for k, (name, stage) in enumerate(stages):
        marker = f"done/{k:04d}-{name}.json"
        entry = json.loads(folder.read(marker)) if fresh and marker.rsplit("/", 1)[1] in folder.names("done") else None
        if entry is None:
            fresh = False
            data = f"{name}-{uuid.uuid4().hex}"
            out = stage(rows)
            out.write.parquet(f"{folder.path}/{data}")
            entry = {"data": data, "schema": out.schema.json()}
            folder.create(marker, json.dumps(entry))
            ran.append(name)
        rows = spark.read.parquet(f"{folder.path}/{entry['data']}")
        if name == until:
            break
    return rows, ran
