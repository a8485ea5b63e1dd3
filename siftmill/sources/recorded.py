"""Recorded answers of sources as a data source of Spark's: a partition for each source and page, which may fail alone."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


class Page(InputPartition):
    def __init__(self, source: str, page: int, path: str):
        super().__init__((source, page, path))
        self.source, self.page, self.path = source, page, path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class RecordedReader(DataSourceReader):
    """Pages of the wanted sources; conditions on source and page choose the files, so that no other is opened."""

    def __init__(self, path: str, tries: int):
        self.path, self.tries = path, tries
        self.sources: set[str] | None = None
        self.pages: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("source",):
                self.sources = values if self.sources is None else self.sources & values
            elif values is not None and f.attribute == ("page",):
                self.pages = values if self.pages is None else self.pages & values
            else:
                yield f

    def partitions(self) -> list[Page]:
        fs, root = file_system(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            if info.type == pafs.FileType.File and not info.base_name.startswith(("_", ".")) and {"source", "page"} <= parts.keys():
                source, page = parts["source"], int(parts["page"])
                if (self.sources is None or source in self.sources) and (self.pages is None or page in self.pages):
                    found.append(Page(source, page, info.path))
        return sorted(found, key=lambda p: (p.source, p.page, p.path))

    def read(self, partition: Page) -> Iterator[tuple]:
        """The page's items as JSON texts. A page that cannot be read to its end is one row with the problem and no items."""
        problem = None
        for _ in range(max(1, self.tries)):
            try:
                fs, _ = file_system(self.path)
                with fs.open_input_stream(partition.path) as f:
                    items = [json.dumps(json.loads(line), sort_keys=True) for line in f.read().decode("utf-8").splitlines() if line.strip()]
            except Exception as e:  # noqa: BLE001 whatever a source does wrong, the others are read
                problem = f"{type(e).__name__}: {e}"[:500]
                continue
            for k, item in enumerate(items):
                yield (partition.source, partition.page, k, item, None)
            return
        yield (partition.source, partition.page, None, None, problem)


class Recorded(DataSource):
    """Answers that were recorded as lines of JSON in folders source=s/page=k below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "source string, page int, pos int, item string, problem string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options["path"], int(self.options.get("tries", "2")))


def register(spark: SparkSession) -> None:
    """Makes the format ``recorded`` known; conditions on source and page are then pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recorded)
