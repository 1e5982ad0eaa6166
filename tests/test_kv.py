import io
import random

import pytest

from stratakeep.engine import Engine
from stratakeep.errors import CorruptStore, InvalidArgument, KeyNotFound, ReservedKey
from stratakeep.operators.kv import COMMANDS, RESERVED
from stratakeep.sources import dump


@pytest.fixture
def kv(spark, tmp_path):
    kv = Engine(spark, f"file://{tmp_path}/kv").kv
    kv.upsert_df(spark.createDataFrame([(k, b"v" + k) for k in (b"b", b"d", b"f", b"h", b"\xff")], "key binary, value binary"))
    return kv


def keys(frame):
    return [bytes(r.key) for r in frame.collect()]


def test_ranges(kv):
    assert keys(kv.range(b"b", b"f")) == [b"b", b"d", b"f"] and keys(kv.range(b"c", b"g")) == [b"d", b"f"] and keys(kv.range(b"x", b"c")) == []
    assert keys(kv.range(b"g", b"c", descending=True)) == [b"f", b"d"] and keys(kv.range(b"a", b"", descending=True)) == []
    assert keys(kv.items()) == [b"b", b"d", b"f", b"h", b"\xff"] and keys(kv.last()) == keys(kv.items())[::-1] and keys(kv.seek(b"e")) == [b"f", b"h", b"\xff"]


def test_client_scans(kv):
    kv.put(RESERVED + b"x", b"hidden")
    assert keys(kv.scan()) == [b"b", b"d", b"f", b"h", b"\xff"] and RESERVED + b"x" in keys(kv.items())
    assert keys(kv.scan(b"c", b"f")) == [b"d", b"f"] and keys(kv.scan(limit=2)) == [b"b", b"d"] and keys(kv.scan(limit=9, cap=3)) == [b"b", b"d", b"f"]
    assert keys(kv.scan(b"g", descending=True, limit=2)) == [b"f", b"d"] and keys(kv.scan(descending=True, limit=1)) == [b"\xff"] and keys(kv.scan(b"h", b"d", True)) == [b"h", b"f", b"d"]
    assert kv.scan(keys_only=True).columns == ["key"]


def test_points_and_guards(kv, spark):
    assert kv.get(b"d") == b"vd" and kv.get(b"zz") is None and kv.need(b"b") == b"vb"
    assert kv.put(b"n", b"") and kv.get(b"n") == b"" and kv.delete(b"n") and not kv.delete(b"n")
    with pytest.raises(KeyNotFound):
        kv.need(b"zz")
    for call in (lambda: kv.need(b""), lambda: kv.put_checked(RESERVED, b""), lambda: kv.delete_checked(b"")):
        with pytest.raises(ReservedKey):
            call()
    with pytest.raises(InvalidArgument):
        kv.put(b"a", b"b", "replace")
    got = kv.get_many(spark.createDataFrame([(b"b",), (b"b",), (b"q",)], "key binary")).collect()
    assert [(bytes(r.key), bytes(r.value)) for r in got] == [(b"b", b"vb")]


def test_batches_are_all_or_nothing(kv):
    assert kv.apply([("put", b"k", b"1", "insert"), ("put", b"k", b"2", "insert"), ("put", b"k", b"3", "update"), ("del", b"b", None, None)])
    assert kv.get(b"k") == b"3" and kv.get(b"b") is None
    assert not kv.apply([("put", b"k", b"3", "upsert"), ("del", b"nothing", None, None), ("put", b"d", b"x", "insert")]) and not kv.apply([])
    for bad in ([("put", b"k", b"9", "upsert"), ("put", b"k", b"9", "odd")], [("put", b"k", b"9", "upsert"), ("get", b"k", None, None)]):
        with pytest.raises(InvalidArgument):
            kv.apply(bad)
    assert kv.get(b"k") == b"3"


def test_random_batches_against_a_model(kv, spark):
    rnd, model = random.Random(3), {k: b"v" + k for k in (b"b", b"d", b"f", b"h", b"\xff")}
    for _ in range(2):
        commands, effects = [], 0
        for seq in range(80):
            key, value = rnd.choice([b"a", b"b", b"c", b"d"]), rnd.choice([b"", b"1", b"2"])
            op, mode = rnd.choice(["put", "put", "del"]), rnd.choice(["upsert", "insert", "update"])
            commands.append((seq, op, key, value if op == "put" else None, mode if op == "put" else None))
            if op == "del":
                effects += model.pop(key, None) is not None
            elif (mode == "upsert" or (mode == "insert") == (key not in model)) and model.get(key) != value:
                model[key] = value
                effects += 1
        rnd.shuffle(commands)
        assert kv.apply_df(spark.createDataFrame(commands, COMMANDS)) == effects
        assert {bytes(r.key): bytes(r.value) for r in kv.items().collect()} == model


def test_store_shares_transactions(spark, tmp_path):
    from stratakeep.operators.kv import KV

    db = Engine(spark, f"file://{tmp_path}/t")
    tx = db.transaction()
    inner = KV(tx.begin)
    assert inner.put(b"a", b"1") and inner.get(b"a") == b"1" and db.kv.get(b"a") is None
    tx.commit()
    assert db.kv.get(b"a") == b"1"


def test_dump_round_trip(kv, spark, tmp_path):
    out = io.BytesIO()
    assert dump.dump_kv(kv, out) == 5
    other = Engine(spark, f"file://{tmp_path}/other").kv
    assert dump.restore_kv(other, io.BytesIO(out.getvalue())) == 5 and other.items().collect() == kv.items().collect()


def test_restore_in_portions_commits_whole_streams_only(kv, spark, tmp_path, monkeypatch):
    out = io.BytesIO()
    dump.dump_kv(kv, out)
    monkeypatch.setattr(dump, "PORTION", 1)  # a portion for each pair
    other = Engine(spark, f"file://{tmp_path}/portions")
    with pytest.raises(CorruptStore):
        dump.restore_kv(other.kv, io.BytesIO(out.getvalue()[:-1]))
    assert other.kv.items().count() == 0 and other.storage.files.names("data") == []
    assert dump.restore_kv(other.kv, io.BytesIO(out.getvalue())) == 5
    assert other.kv.items().collect() == kv.items().collect() and other.vacuum() == 0


def test_dump_layout_and_damage():
    assert dump.crc32c(b"123456789") == 0xE3069283  # the check value of CRC-32C
    out = io.BytesIO()
    dump.write_dump(out, [(b"k", b"v" * 300)], magic=b"M")
    data = out.getvalue()
    assert data[:4] == b"M\x01\x01k" and data[4:6] == b"\xac\x02" and data[6:306] == b"v" * 300 and data[306:308] == b"\x00\x01"
    assert list(dump.read_dump(io.BytesIO(data), b"M")) == [(b"k", b"v" * 300)]
    for broken in (data[:-1], data[:50], b"X" + data[1:], data[:20] + b"w" + data[21:], data[:1] + b"\x07" + data[2:], data[:-5] + b"\x02" + data[-4:], b"M\x01" + b"\xff" * 9 + b"\x01"):
        with pytest.raises(CorruptStore):
            list(dump.read_dump(io.BytesIO(broken), b"M"))
