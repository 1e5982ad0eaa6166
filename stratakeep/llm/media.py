"""Content-addressed payloads in tar shards, with metadata columns from header-only reads.

A payload is stored once, as an 8-bit grey PNG image 576 samples wide whose file name is the
payload's digest.  Rows carry digest, shard, offset and length; width, height, depth and colour are
filled by reading the first 33 bytes of each image in place.

Payloads never cross an exchange: each task writes the shards of its own rows, one image for each
distinct payload that it meets, and only addresses are grouped by digest.  Where several tasks met
a payload, rows carry the least address, so equal payloads share one; a payload that a third of
all rows share is stored at most once a task.  Shards are named at random and reported through a
table that only finished tasks feed.

Edge cases: a null text counts as empty, and an empty payload is one row of padding; equal texts
share one stored image; rows that repeat an id get a result each; null ids pass through.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, new_path, released, shared_fs, ship, width

ROW = 576
SHARD_BYTES = 128 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of ROW."""
    return data + b"\xff" * ((-len(data)) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes of an image."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", data[16:26])


def from_png(data: bytes) -> bytes:
    """Samples of an image that ``to_png`` made (8-bit grey, no filter)."""
    w, h, depth, colour = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, w + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("unexpected sample format or filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A difference hash: are the means of 65 even stretches rising?  16 hex digits."""
    data = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(data), 66).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.diff(edges)
    return np.packbits(means[1:] > means[:-1]).tobytes().hex()


def _tar_header(name: str, size: int) -> bytes:
    fields = [name.encode().ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0"]
    length = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    fields += [length, b"00000000000\0", b" " * 8, b"0", b"\0" * 100, b"ustar\0", b"00", b"\0" * 64, b"0000000\0", b"0000000\0", b"\0" * 167]
    block = b"".join(fields)
    return block[:148] + b"%06o\0 " % sum(block) + block[156:]


def store(docs: DataFrame, folder: str, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store payloads; one row for each distinct one: digest, shard, offset, length, media_sha256."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        seen: set[bytes] = set()
        name, out, size = "", None, 0
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 64):
                for data in batch.column(0).slice(at, 64).to_pylist():
                    payload = pad(data or b"")
                    digest = hashlib.sha256(payload)
                    if digest.digest() in seen:
                        continue
                    seen.add(digest.digest())
                    image = to_png(payload)
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{root}/{name}")
                    out.write(_tar_header(f"{digest.hexdigest()}.png", len(image)) + image + b"\0" * (-len(image) % 512))
                    rows.append((digest.digest(), f"{folder}/{name}", size + 512, len(image), hashlib.sha256(image).digest()))
                    size += 512 + len(image) + -len(image) % 512
                    if size >= shard_bytes:
                        out.write(b"\0" * 1024)
                        out.close()
                        out = None
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "shard", "offset", "length", "media_sha256"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    written = docs.select(F.col(f"`{text}`").cast("binary").alias("data")).mapInArrow(released(run), "digest binary, shard string, offset long, length long, media_sha256 binary")
    written = materialise(written, "addresses")  # all shards are closed before any address is used
    least = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "media_sha256")).alias("at"))
    out = least.select(_hex("digest"), "at.shard", "at.offset", "at.length", _hex("at.media_sha256").alias("media_sha256"))
    out._stratakeep_path = written._stratakeep_path
    return out


def _hex(column: str):
    return F.lower(F.hex(column)).alias(column)


def _ranges(stored: DataFrame) -> DataFrame:
    """Rows in the order of their bytes, a stretch of a shard together; digests travel as bytes."""
    stored = stored.select(F.unhex("digest").alias("digest"), "shard", "offset", "length", F.unhex("media_sha256").alias("media_sha256"))
    return stored.repartition(width(stored.sparkSession), "shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")


class _Shards:
    """The shard that was read last stays open."""

    def __init__(self):
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            fs, path = shared_fs(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return bytes(self.file.read_at(length, offset))


def metadata(stored: DataFrame) -> DataFrame:
    """Add width, height, depth and colour to manifest rows, from header-only range reads."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards()
        for batch in batches:
            heads = [png_header(shards.read(s, o, HEADER)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            digests = [pa.array([x.hex() for x in batch.column(i).to_pylist()], pa.string()) for i in (0, 4)]
            columns = [digests[0], *batch.columns[1:4], digests[1]] + [pa.array([x[i] for x in heads], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "width", "height", "depth", "colour"])

    schema = "digest string, shard string, offset long, length long, media_sha256 string, width int, height int, depth int, colour int"
    return _ranges(stored).mapInArrow(released(run), schema)


def features(described: DataFrame) -> DataFrame:
    """Read whole images back: payload_bytes, payload_sha256, tail_crc32, feature; checks digests."""
    ship(described.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards()
        for batch in batches:
            rows = []
            for digest, shard, offset, length, want in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                image = shards.read(shard, offset, length)
                payload = from_png(image)
                got = hashlib.sha256(payload).hexdigest()
                if got != digest or hashlib.sha256(image).hexdigest() != want:
                    raise ValueError(f"stored bytes of {digest} differ")
                rows.append((len(payload), got, zlib.crc32(payload[-32:]), feature(payload)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in described.schema) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return described.mapInArrow(released(run), schema)


def addressed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the digest of the padded payload, computed without Python."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), data.alias("data")).withColumn("n_bytes", F.length("data").cast("long"))
    missing = F.when(F.col("n_bytes") == 0, F.lit(ROW)).otherwise(F.pmod(-F.col("n_bytes"), F.lit(ROW))).cast("int")
    filling = F.lit(b"\xff" * ROW).substr(F.lit(1), missing)
    return base.select("doc_id", "n_bytes", F.sha2(F.concat("data", filling), 256).alias("digest"))


def media_folder(spark) -> str:
    return new_path(spark, "media")
