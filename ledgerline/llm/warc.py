"""WARC archives, index first: writing returns an index of every record's file, offset, length, URL and
payload digest; reading starts from index rows and fetches the selected records with sorted,
coalesced byte ranges.

Writing: each task streams its rows into archives in the shared folder, one gzip member per record, and
starts a new archive at ``archive_bytes``. An archive's name holds a random part, and only the index rows of
the task attempt that Spark commits name it, so a repeated or lost attempt leaves an unreferenced file and no
wrong row. The index is written as Parquet. Payloads move through no shuffle unless the table of repeated
digests is too large for Spark to broadcast by its own size check.

Records: of pages with equal payloads (SHA-1) of at least ``min_bytes`` the one with the smallest page_id is the
``response``; the others are ``revisit`` records without a payload that refer to it.

Storage is reached with ``pyarrow.fs`` by the folder's URI, on the executors.

Nulls and odd rows: null html is an empty payload; a null URL is left out of the header and read back as null; rows with a
null page_id, and rows that repeat the smallest page_id, are responses; control characters in a URL are
percent-encoded in the header and decoded on reading; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, table, written
from ledgerline.session import scratch_path

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 16 << 20  # compressed bytes read by a task, about
DATE = "2024-01-01T00:00:00Z"
INDEX = ("file string, offset bigint, length bigint, url string, page_id bigint, record_type string, "
         "refers_to bigint, payload_digest string, payload_bytes bigint")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def url_header(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0], safe=""), url)


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries the full payload's digest and size, but no payload."""
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "Content-Type: text/html; charset=utf-8",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url_header(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload) of one record; the payload of
    a response is checked against its digest."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body = record[end + 4:end + 4 + int(head["Content-Length"])]
    number = lambda name: int(x) if (x := re.sub(r"\D*(-?\d*)>$", r"\1", head.get(name, ""))) else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and base32_digest(body) != digest:
        raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digest")
    url = unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
    size = len(body) if head["WARC-Type"] == "response" else int(head["X-Payload-Length"])
    return number("WARC-Record-ID"), url, head["WARC-Type"], number("WARC-Refers-To"), digest, size, body


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the returned index is a written table."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    groups = written(groups, "revisits")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    joined = rows.join(groups, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = scratch_path(spark, "warc")
    target = arrow_schema(spark, INDEX)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for row_id, link, value, refers_to in zip(*batch.columns):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    payload, row_id, link, refers_to = value.as_py(), row_id.as_py(), link.as_py(), refers_to.as_py()
                    digest = base32_digest(payload)
                    member = gzip_member(render(row_id, link, payload, digest, refers_to))
                    out.write(member)
                    found.append((f"{folder}/{name}", at, len(member), link, row_id, "response" if refers_to is None else "revisit",
                                  refers_to, digest, len(payload)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(target)], schema=target)
        finally:
            if out is not None:
                out.close()

    return written(joined.mapInArrow(store, INDEX), "warc-index")


def read_records(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the given index rows (any selection): page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload.

    Rows are dealt out by stretches of their archive, sorted by offset, and neighbours up to ``gap_bytes`` apart are
    fetched together, up to ``range_bytes`` at a time. One shuffle of index rows, none of payloads.
    """
    target = arrow_schema(index.sparkSession, RECORD)
    stretch = F.floor(F.col("offset") / range_bytes)
    # tasks by the bytes to read, not by the size of the index rows
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    placed = index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        opened = (None, None)
        for batch in batches:
            names, offsets, lengths = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(names):
                k, end = i + 1, offsets[i] + lengths[i]
                while (k < len(names) and names[k] == names[i] and offsets[k] - end <= gap_bytes
                       and offsets[k] + lengths[k] - offsets[i] <= range_bytes):
                    end = max(end, offsets[k] + lengths[k])
                    k += 1
                if opened[0] != names[i]:
                    where, path = fs.FileSystem.from_uri(names[i])
                    opened = (names[i], where.open_input_file(path))
                data = opened[1].read_at(end - offsets[i], offsets[i])
                start = offsets[i]
                found = [parse(zlib.decompress(data[offsets[j] - start:offsets[j] - start + lengths[j]], 31)) for j in range(i, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], f.type) for c, f in enumerate(target)], schema=target)
                i = k

    return placed.mapInArrow(fetch, RECORD)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = read_records(write_archives(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p
), c AS (
  SELECT page_id, payload_bytes, first,
    [list_sum([CAST(instr('0123456789abcdef', substr(hex, CAST(k * 10 + i AS INTEGER), 1)) - 1 AS BIGINT) << CAST(4 * (10 - i) AS INTEGER)
               for i in generate_series(1, 10)]) for k in generate_series(0, 3)] AS quads FROM d
)
SELECT page_id, payload_bytes, array_to_string([array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(q AS BIGINT) >> CAST(5 * (7 - j) AS INTEGER)) & 31) AS INTEGER), 1)
    for j in generate_series(0, 7)], '') for q in quads], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
