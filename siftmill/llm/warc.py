"""Web archives: records written one gzip member each, read back sequentially.

A record is a response with its payload, or a revisit of the response with the same payload. Archives are written by
the tasks that hold the pages, into a folder that all executors share, through whatever file system its address names;
a manifest lists those that were closed. The reader goes through an archive once: it inflates member after member as
bytes arrive, frames headers and block by Content-Length and verifies the digests of block and payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import join_groups, join_small, scratch, stored, table

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:siftmill:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def opened(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record. Line breaks in header values become spaces."""
    head = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in headers)]
    head += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Length: %d" % len(block)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join([*head, b"", block, b"", b""])) + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<{URN}{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or f"{URN}{page_id}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return record(headers, HTTP % len(payload) + (payload if refers_to is None else b""))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, payload binary, payload_digest, refers_to) and returns the manifest (archive, records).

    Each task starts a new archive after about ``archive_bytes``. Names are new in every attempt, so that what a lost
    attempt leaves is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and size >= archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, path = opened(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: siftmill\r\nformat: WARC File Format 1.1\r\n"))
                made = page_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], date)
                out.write(made)
                records, size = records + 1, size + len(made)
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "archive string, records long")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def page_of(self, name: str) -> int | None:
        value = self.headers.get(name, "").strip("<>")
        return int(value.removeprefix(URN)) if value.startswith(URN) else None


def members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, as the stream's bytes arrive."""
    inflate, parts, fresh = zlib.decompressobj(31), [], True
    while data := stream.read(chunk):
        while data:
            fresh = False
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends inside a record")


def parsed(member: bytes) -> Record:
    """The record of a member; wrong framing or a wrong digest is an error."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record where one should start")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8").partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block does not have its Content-Length")
    if (want := headers.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {headers.get('warc-record-id')}")
    return Record(headers, block)


def payload_of(r: Record) -> tuple[int, bytes | None]:
    """The payload's length as HTTP tells it, and the payload of a response, its digest verified."""
    head, _, payload = r.block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)[1])
    if r.headers["warc-type"] == "revisit":
        return length, None
    if len(payload) != length or r.headers["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"payload digest of {r.headers.get('warc-record-id')}")
    return length, payload


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit in the archives of the manifest; a damaged or short archive is an error."""
    spark = manifest.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(archive: str, records: int) -> Iterator[tuple]:
        system, path = opened(archive)
        count = 0
        with system.open_input_stream(path, compression=None) as stream:
            for member in members(stream):
                r = parsed(member)
                if (kind := r.headers["warc-type"]) not in ("response", "revisit"):
                    continue
                length, payload = payload_of(r)
                count += 1
                uri = r.headers["warc-target-uri"]
                yield (r.page_of("warc-record-id"), None if uri.startswith(URN) else uri, length, r.headers["warc-payload-digest"].removeprefix("sha256:"), kind, r.page_of("warc-refers-to"), *[payload] * with_payload)
        if count != records:
            raise ValueError(f"{archive} has {count} records, its manifest {records}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for row in rows(archive, records):
                    held.append(row)
                    size += row[2] if with_payload else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)

    tasks = max(1, min(10_000, manifest.count()))
    return spark.createDataFrame([], schema) if manifest.isEmpty() else manifest.select("archive", "records").repartition(tasks).mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page and returns the manifest.

    The payload is the html in UTF-8, null counts as empty. Of equal payloads of at least LEAST_REVISIT bytes the one
    with the smallest page_id is the response and the others revisit it; smaller ones are all responses. A repeated page
    is a record each time. Null and empty urls are read back as null. Ids are integers; a page without one is archived as it is and
    read back without one, and no page revisits it. Other columns are not archived.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    digests = stored(rows.select("page_id", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("n")), "digests")
    groups = digests.filter(F.col("n") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    revisits = join_groups(digests, stored(groups, "groups"), ["payload_digest"], "copies", digests.count())
    revisits = stored(revisits.filter("page_id > first").groupBy("page_id", "payload_digest").agg(F.min("first").alias("refers_to")), "revisits")
    made = join_small(rows.withColumn("payload_digest", F.sha2("payload", 256)), revisits, ["page_id", "payload_digest"], "left")
    return stored(write_archives(made, folder), "manifest")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    manifest = archived(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT page_id, n, digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
