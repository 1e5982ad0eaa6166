import io
import json

import pytest

from stratakeep.cli import normalize, run
from stratakeep.engine import Engine
from stratakeep.streaming.upserts import upsert_stream


@pytest.fixture
def call(spark, tmp_path):
    def call(*argv, source=""):
        out = io.StringIO()
        code = run(["--root", f"{tmp_path}/db", *argv], spark, out, io.StringIO(source))
        return code, out.getvalue()

    return call


def test_statements_and_prompt(call):
    script = "\\h\ncreate table t (a int64,\n primary key (a));\ninsert into t values (1);\nselect b from t;\nselect a from t\n;\nselect a + 1 from t"
    out = call("sql", source=script)[1]
    assert out.count("OK, 0 rows affected") == 1 and "OK, 1 row affected" in out and "error: unknown column" in out and "|       2 |" in out
    assert json.loads(call("sql", "--format", "json", "select a from t")[1])["rows"] == [[1]]
    assert call("sql", source="\\q\nselect a from t;")[1] == "" and call("tables")[1] == "t\n"
    assert call("sql", "select nothing from t")[0] == 1
    assert normalize(" a ") == "a;" and normalize("a;") == "a;" and normalize("") == ""


def test_keys_and_maintenance(call, tmp_path, spark):
    assert call("kv", "put", "a", "1") == (0, "updated\n") and call("kv", "put", "a", "1") == (0, "unchanged\n") and call("kv", "put", "b", "2", "--mode", "update") == (0, "unchanged\n")
    call("kv", "put", "b", "2")
    assert call("kv", "get", "a") == (0, "1\n") and call("kv", "get", "zz")[0] == 1
    assert call("kv", "range", "--descending", "--limit", "1")[1] == "b\t2\n" and call("kv", "range", "b", "--keys-only")[1] == "b\n"
    assert call("dump", f"{tmp_path}/d")[1] == "2 entries\n" and call("kv", "delete", "a")[1] == "deleted\n" and call("kv", "delete", "a")[1] == "not found\n"
    assert call("restore", f"{tmp_path}/d")[1] == "2 entries\n" and call("kv", "get", "a")[1] == "1\n"
    assert call("compact")[0] == 0 and "deleted" in call("vacuum")[1]
    call("export", f"{tmp_path}/copy")
    assert Engine(spark, f"file://{tmp_path}/copy").kv.get(b"b") == b"2"
    assert call("version")[1].strip()


def test_benchmark(call):
    got = json.loads(call("benchmark", "--keys", "200", "--reads", "50", "--value-size", "32")[1])
    assert set(got) == {"populate", "compact", "random_read", "iterate_keys", "iterate_values", "batch_commits", "point_read", "reopen"} and got["populate"]["ops"] == 200


def test_stream_of_upserts(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/db")
    db.create_table("t", [("k", "int64"), ("v", "string")], ["k"])
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string").coalesce(1)
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        frame(rows).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
        upsert_stream(db, "t", stream, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
        assert len(db.table("t").collect()) == 2 + i
    assert db.sql("select * from t;").rows() == [(1, "a"), (2, "c"), (3, "d")]
