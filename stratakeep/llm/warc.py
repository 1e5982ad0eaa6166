"""WARC records in ZIP-packaged archives: written by partition, read back by byte range.

An archive is a ZIP container with a stored member of records, each a gzip member of its own, and
a stored index that gives every record's offset and length in it.  A payload of ``MIN_PAYLOAD``
bytes or more that several pages share is kept once, as the response of the smallest page id; the
other pages get revisit records, which carry headers and digest but no payload.

Writers name files at random and report them through a table that only finished tasks feed, so a
retried or lost task leaves at most a file that nobody reads.

Edge cases: a null html counts as an empty payload; empty payloads are responses; a null page id is
always a response and never referred to; rows that repeat a page id get a record each, and of equal
payloads those under the smallest id are all responses; such records, and those of null ids, share
their record id, which is made of the page id; a null url becomes the empty target; white space and
control characters in a url are percent-encoded, as a header can't hold them.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, new_path, released, shared_fs, ship, width
from .ziparchive import Reader, Writer

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 32 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2000-01-01T00:00:00Z"
# what would end a header or be trimmed from it
_SPACES = re.compile(r"[\s\x00-\x1f\x7f]")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed.  A revisit keeps the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_SPACES.sub(lambda m: quote(m[0]), url)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's length as its HTTP header gives it, and the payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to for every row of ``pages``."""
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    shared = base.where(F.length("payload") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialise(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "shared-payloads")
    joined = base.join(shared, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write planned records as archives below ``folder``; rows: archive, records, bytes."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        parts: list[bytes] = []
        index: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as out:
                archive = Writer(out, zip64)
                archive.add(RECORDS, b"".join(parts))
                archive.add(INDEX, "\n".join(index).encode())
                total = archive.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.compress(record(*row), 6, mtime=0)
                index.append(json.dumps({"id": row[0], "offset": size, "length": len(data)}))
                parts.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield flush()
                    parts, index, size = [], [], 0
        if parts:
            yield flush()

    return materialise(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(released(run), "archive string, records long, bytes long"), "archives")


def index(archives: DataFrame) -> DataFrame:
    """Byte ranges of all records, from the directories and index members alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = shared_fs(path)
                with fs.open_input_file(at) as file:
                    archive = Reader(file)
                    start = archive.data_at(RECORDS)
                    lines = [json.loads(x) for x in archive.read(INDEX).decode().split("\n") if x]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([start + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], names=["archive", "at", "size"])

    spread = archives.select("archive").repartition(width(archives.sparkSession), "archive")
    return spread.mapInArrow(released(run), "archive string, at long, size long")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives, read by its own byte range and checked against its digest.

    Rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).
    """
    spark = archives.sparkSession
    ship(spark)
    ranges = index(archives).repartition(width(spark), "archive", F.floor(F.col("at") / (4 << 20))).sortWithinPartitions("archive", "at")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def page(text: str | None) -> int | None:
        text = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    if file:
                        file.close()
                    fs, place = shared_fs(path)
                    name, file = path, fs.open_input_file(place)
                headers, length, payload = parse(gzip.decompress(bytes(file.read_at(size, at))))
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                kind = headers["warc-type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                    raise ValueError(f"record at {at} of {path} doesn't match its digest")
                rows.append((page(headers["warc-record-id"]), headers["warc-target-uri"], length, digest, kind, page(headers.get("warc-refers-to")), payload)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if file:
            file.close()

    return ranges.mapInArrow(released(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
