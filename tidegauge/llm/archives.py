"""WARC archives: written from pages, read back, and deduplicated with revisit records.

Records are ended by two line breaks, which is also how Spark's text writer is
told to end its rows, so archives are written by Spark's own commit protocol to
any file system, gzip-compressed. They are read by their ``Content-Length``
fields, since payloads may hold any line breaks.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterator
from hashlib import sha1
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import fresh_path

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: A compressed archive file is read as one row, so its size is bounded; records are taken from it one by one.
RECORDS_PER_FILE = 2000
FILE_BYTES = 16 << 20
ARCHIVED = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, " \
           "refers_to long, payload string"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1 without a label."""
    return base64.b32encode(sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _field(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded, outer spaces go."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 else c for c in (value or "").strip(" "))


def record(row: dict) -> str:
    """One record without its end. A revisit repeats the digest and names its original, but has no payload."""
    payload = row["payload"] or ""
    revisit = row["record_type"] == "revisit"
    block = HTTP % row["payload_bytes"] + ("" if revisit else payload)
    head = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['url'])}",
            f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_field(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['refers_url'])}",
                 f"X-Refers-To-Page-Id: {row['refers_to']}"]
        if row["refers_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_field(row['refers_url'])}")
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def _lines(file: BinaryIO) -> list[str]:
    """The lines up to an empty one; none at the end of the file."""
    out = []
    while line := file.readline():
        if line == b"\r\n":
            return out
        out.append(line.removesuffix(b"\r\n").decode())
    if out:
        raise ValueError("a record's header is cut off")
    return out


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(line.split(":", 1) for line in lines)


def parse(file: BinaryIO) -> Iterator[dict]:
    """The records of an archive, one at a time; a truncated or foreign one is an error, not a silent end."""
    while lines := _lines(file):
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k: v.strip(" ") for k, v in _fields(lines[1:]).items()}
        block = file.read(int(fields["Content-Length"]))
        if len(block) < int(fields["Content-Length"]) or file.read(4) != b"\r\n\r\n":
            raise ValueError("a record's block is cut off")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head.decode().split("\r\n")[1:])
        revisit = fields["WARC-Type"] == "revisit"
        yield {
            "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
            "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
            "refers_to": int(fields["X-Refers-To-Page-Id"]) if revisit else None,
            "payload": None if revisit else payload.decode(),
        }


ROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.string()),
])


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``record`` rows (see :func:`from_pages`) as gzip-compressed archive files."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                yield pa.RecordBatch.from_arrays([pa.array([record(r) for r in part.to_pylist()], pa.string())], ["value"])

    (
        records.mapInArrow(lines, "value string").write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


def _small(batch: pa.RecordBatch, size: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes, one row at least."""
    step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below ``path``; without ``payloads`` only their headers."""
    keep = [f.name for f in ROW if payloads or f.name != "payload"]
    schema = pa.schema([f for f in ROW if f.name in keep])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                data = content.as_py()
                opened = io.BytesIO(data)
                for row in parse(gzip.GzipFile(fileobj=opened) if data[:2] == b"\x1f\x8b" else opened):
                    held.append({k: row[k] for k in keep})
                    size += len(row["payload"] or "") if payloads else 1
                    if size >= FILE_BYTES or len(held) >= RECORDS_PER_FILE:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    makes = ", ".join(p for p in ARCHIVED.split(", ") if p.split(" ")[0] in keep)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(rows, makes)


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as response records; a null html is an empty payload."""
    body = F.coalesce(F.col(html), F.lit(""))
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                payloads = [p.encode() for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(["response"] * len(payloads)), pa.array(map(payload_digest, payloads), pa.string()),
                    pa.array(map(len, payloads), pa.int64()), pa.nulls(len(payloads), pa.int64()),
                    pa.nulls(len(payloads), pa.string()),
                ], names=[*RECORD_NAMES])

    return narrow.mapInArrow(digest, RECORD)


RECORD_NAMES = ("page_id", "url", "payload", "record_type", "payload_digest", "payload_bytes", "refers_to", "refers_url")
RECORD = "page_id long, url string, payload string, record_type string, payload_digest string, payload_bytes long, " \
         "refers_to long, refers_url string"


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The original ``(payload_digest, payload_bytes, refers_to, refers_url)`` of every payload that is large enough.

    Only responses are originals. Minima combine before the shuffle, so a
    payload that very many pages share sends one row per task. A page without
    id is an original only where no page with that payload has one.
    """
    whole = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    return whole.groupBy("payload_digest", "payload_bytes").agg(first.alias("first")).select(
        "payload_digest", "payload_bytes", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")
    )


def deduplicate(spark: SparkSession, path: str, out: str, min_bytes: int = 0) -> None:
    """Read the archives below ``path`` and write them below ``out``, every copy of a payload as a revisit.

    Copies that were revisits already point to the resolved original as well; one
    without any response keeps what it referred to.
    Records with equal page id and payload all stay responses, so no payload is
    lost when rows repeat.
    """
    records = read_archives(spark, path)
    originals = resolve(read_archives(spark, path, payloads=False), min_bytes)
    copy = F.col("found").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("found"))
    joined = records.join(
        originals.withColumnRenamed("refers_to", "found"), ["payload_digest", "payload_bytes"], "left"
    )
    fresh = joined.select(
        "page_id", "url", F.when(~F.coalesce(copy, F.lit(False)), F.col("payload")).alias("payload"),
        F.when(copy, "revisit").otherwise(F.col("record_type")).alias("record_type"), "payload_digest", "payload_bytes",
        F.when(copy, F.col("found")).otherwise(F.col("refers_to")).alias("refers_to"),
        F.when(copy, F.col("refers_url")).alias("refers_url"),
    )
    write_archives(fresh, out)


def archive_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Write the pages as archives, deduplicate those, read the result back: one header row per page.

    Null ids and urls are left out of the record and come back as null; a page
    without id stays a response. A null html is an empty payload. Repeated rows
    each get a record. Other columns play no part. An empty table gives none.
    """
    spark = pages.sparkSession
    base = folder or fresh_path(spark, "archives")
    write_archives(from_pages(pages, page_id, url, html), f"{base}/raw")
    deduplicate(spark, f"{base}/raw", f"{base}/deduplicated", min_bytes)
    return read_archives(spark, f"{base}/deduplicated", payloads=False)
