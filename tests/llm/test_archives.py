import hashlib
import io
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest

from stratakeep.llm import media, warc
from stratakeep.llm._common import shared_fs
from stratakeep.llm.ziparchive import Reader, Writer


@pytest.mark.parametrize("zip64", [False, True])
def test_container_round_trip(zip64):
    out = io.BytesIO()
    writer = Writer(out, zip64)
    members = {"archive/a": b"x" * 1000, "ü": b"", "indexes/i": b"index"}
    for name, data in members.items():
        writer.add(name, data)
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:  # another reader agrees
        assert {i.filename: other.read(i) for i in other.infolist()} == members
    reader = Reader(pa.BufferReader(out.getvalue() + b""))
    assert {n: reader.read(n) for n in reader.members} == members
    assert bytes(reader.file.read_at(3, reader.data_at("indexes/i") + 1)) == b"nde"


def test_reader_takes_other_writers_and_refuses_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("s", b"stored")
        archive.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        archive.comment = b"PK\x05\x06 comment"
    reader = Reader(pa.BufferReader(out.getvalue()))
    assert reader.read("s") == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        reader.read("d")
    with pytest.raises(ValueError, match="not a ZIP"):
        Reader(pa.BufferReader(b"nothing here"))


def pages(spark):
    big, other = "<p>é" + "x" * 200, "y" * 99
    rows = [(5, "u", big), (3, "v", big), (9, None, big), (1, "w", other), (2, "w", other), (4, "a b", None), (6, "x", ""), (None, "n", big), (3, "v", big), (7, "z", "z" * 100), (8, "z", "z" * 100)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_warc_round_trip(spark):
    rows, frame = pages(spark)
    archives = warc.write(warc.plan_records(frame), warc.archive_folder(spark), archive_bytes=300, zip64=True)
    got = warc.read(archives, with_payload=True).collect()
    assert len(got) == len(rows) and archives.count() > 1
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        ref = first.get(h) if i is not None and first.get(h) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if ref else "response", ref))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload) == b"" for r in got if r.record_type == "revisit")
    assert warc.read(warc.write(warc.plan_records(frame.limit(0)), warc.archive_folder(spark))).count() == 0


def test_urls_are_kept_but_for_what_a_header_cannot_hold():
    for url, kept in [("http://x/a  b\r\nX: 1", "http://x/a%20%20b%0D%0AX:%201"), (" ü?q=%20#f", "%20ü?q=%20#f"), ("", ""), ("a\u2028b", "a%E2%80%A8b")]:
        headers, length, payload = warc.parse(warc.record(1, url, b"data", "d", None))
        assert headers["warc-target-uri"] == kept and (length, payload) == (4, b"data") and "x" not in headers


def test_media_round_trip(spark):
    texts = ["", None, "a", "é" * 288, "x" * 577, "a", "b" * 5000, "a"]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, digest int, shard string")
    folder = media.media_folder(spark)
    stored = media.store(frame, folder, shard_bytes=700)
    assert stored.count() == 5  # distinct payloads, null and empty being one
    described = {r.digest: r for r in media.features(media.metadata(stored)).collect()}
    for row in media.addressed(frame).collect():
        data = (texts[row.doc_id] or "").encode()
        payload = media.pad(data)
        found = described[row.digest]
        assert (row.n_bytes, found.payload_bytes, found.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert found.tail_crc32 == zlib.crc32(payload[-32:]) and found.width * found.height == len(payload)
        fs, path = shared_fs(found.shard)
        with fs.open_input_file(path) as file:  # an ordinary tar reader finds the same member
            whole = tarfile.open(fileobj=io.BytesIO(file.read()))
        member = whole.getmember(f"{found.digest}.png")
        assert (member.offset_data, member.size) == (found.offset, found.length)
    assert media.features(media.metadata(media.store(frame.limit(0), folder))).count() == 0
