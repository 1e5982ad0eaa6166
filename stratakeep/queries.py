"""Queries over the test tables, one or more for each operator of the engine, and their SQL.

Each builds a store of its own in a new folder and leaves the tables that it reads alone.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import normalize
from .cli import run as command_line
from .engine import Engine
from .errors import StrataError, TxConflict
from .operators.kv import TABLE as KV_TABLE
from .sources import dump
from .sources.fixtures import register
from .sources.generator import pairs as generated
from .sources.storage import Manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: The orders table as the dialect sees it.
_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS o_day, o_orderpriority FROM orders)"


def _query(name: str, oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle.replace("ORDERS", _ORDERS)
        return f

    return add


def _select(name: str, table: str, sql: str, oracle: str, columns: list[str] | None = None) -> None:
    """A SELECT in the dialect, columns renamed in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = register(Engine.scratch(spark, name), sf_dir, table).sql(sql).dataframe
        return out.toDF(*columns) if columns else out

    _query(name, oracle)(run)


def _orders(spark: SparkSession, sf_dir: str, tag: str) -> Engine:
    return register(Engine.scratch(spark, tag), sf_dir, "orders")


_ALL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_day, o_orderpriority FROM ORDERS"

_select("s2_full_scan", "nation", "SELECT * FROM nation;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_select("s2_full_scan_lineitem", "lineitem", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem;", "SELECT l_orderkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice FROM lineitem")
_select("s3_pk_range", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500;", "SELECT o_orderkey, o_custkey FROM ORDERS WHERE o_orderkey >= 100 AND o_orderkey < 500")
_select("s4_tuple_range", "orders", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) >= (100, 5000);", "SELECT o_custkey, o_orderkey FROM ORDERS WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey >= 5000)")
_select("s4_key_prefix", "events", "SELECT event_id, user_id FROM events WHERE user_id > 10 AND (user_id, ts_micros) <= (40, 1700000000000000);", "SELECT event_id, user_id FROM events WHERE user_id > 10 AND (user_id < 40 OR (user_id = 40 AND epoch_us(ts) <= 1700000000000000))")
_select("s5_pk_point", "orders", "SELECT * FROM orders WHERE o_orderkey = 77;", f"{_ALL} WHERE o_orderkey = 77")
_select("s5_eq_prefix", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 7;", "SELECT o_orderkey FROM ORDERS WHERE o_custkey = 7")
_select("x4_x9_arithmetic", "orders", "SELECT o_orderkey, o_custkey * 2 - o_orderkey, -o_custkey, o_orderkey / 7, (o_custkey - o_orderkey) / 3 FROM orders;", "SELECT o_orderkey, o_custkey * 2 - o_orderkey AS a, -o_custkey AS b, o_orderkey // 7 AS c, (o_custkey - o_orderkey) // 3 AS d FROM ORDERS", ["o_orderkey", "a", "b", "c", "d"])
_select("x4_wrap", "nation", "SELECT n_nationkey, 9223372036854775807 + n_nationkey, 4611686018427387904 * 2 + n_nationkey, -(-9223372036854775807 - 1) FROM nation;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey = 0 THEN 9223372036854775807 ELSE -9223372036854775808 + (n_nationkey - 1) END AS a, -9223372036854775808 + n_nationkey AS b, -9223372036854775808 AS c FROM nation", ["n_nationkey", "a", "b", "c"])
_select("x8_concat", "orders", "SELECT o_orderkey, o_orderstatus + '-' + o_orderpriority FROM orders;", "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS a FROM ORDERS", ["o_orderkey", "a"])
_select("x10_x14_logic", "orders", "SELECT o_orderkey, o_custkey = 1 OR NOT o_orderkey < 9 AND o_orderstatus <> 'F', NOT o_custkey, o_orderstatus < 'O' FROM orders;", "SELECT o_orderkey, CAST(o_custkey = 1 OR (NOT o_orderkey < 9 AND o_orderstatus <> 'F') AS BIGINT) AS a, CAST(o_custkey = 0 AS BIGINT) AS b, CAST(o_orderstatus < 'O' AS BIGINT) AS c FROM ORDERS", ["o_orderkey", "a", "b", "c"])
_select("x15_tuple_comparisons", "orders", "SELECT o_orderkey, (o_orderstatus, o_custkey) < ('O', 50), (o_orderstatus, o_custkey) <= ('O', 50), (o_orderstatus, o_custkey) > ('O', 50), (o_orderstatus, o_custkey) >= ('O', 50), (o_orderstatus, o_custkey) = ('O', 50), (o_orderstatus, o_custkey) != ('O', 50) FROM orders;", "SELECT o_orderkey, CAST(s < 'O' OR (s = 'O' AND k < 50) AS BIGINT) AS a, CAST(s < 'O' OR (s = 'O' AND k <= 50) AS BIGINT) AS b, CAST(s > 'O' OR (s = 'O' AND k > 50) AS BIGINT) AS c, CAST(s > 'O' OR (s = 'O' AND k >= 50) AS BIGINT) AS d, CAST(s = 'O' AND k = 50 AS BIGINT) AS e, CAST(NOT (s = 'O' AND k = 50) AS BIGINT) AS f FROM (SELECT o_orderkey, o_orderstatus AS s, o_custkey AS k FROM ORDERS)", ["o_orderkey", "a", "b", "c", "d", "e", "f"])
_select("x17_chaining", "orders", "SELECT o_orderkey, o_custkey < o_orderkey < 1 FROM orders;", "SELECT o_orderkey, CAST(NOT o_custkey < o_orderkey AS BIGINT) AS a FROM ORDERS", ["o_orderkey", "a"])
_select("p2_star_mix", "nation", "SELECT *, n_nationkey FROM nation;", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS k2 FROM nation", ["k", "n", "r", "k2"])
_select("f1_residual", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 10 AND o_orderstatus = 'P';", "SELECT o_orderkey, o_totalprice FROM ORDERS WHERE o_orderkey > 10 AND o_orderstatus = 'P'")
_select("f1_arithmetic_filter", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_extendedprice / (l_discount + 1) > 100000 AND NOT l_returnflag = 'N';", "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) // (CAST(round(l_discount * 100) AS BIGINT) + 1) > 100000 AND l_returnflag <> 'N'")
_select("o1_index_order_limit", "orders", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 900 LIMIT 9;", "SELECT o_custkey, o_orderkey FROM ORDERS WHERE o_custkey >= 900 ORDER BY 1, 2 LIMIT 9")
_select("o2_descending_limit", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 500 LIMIT 7;", "SELECT o_orderkey FROM ORDERS WHERE o_orderkey <= 500 ORDER BY 1 DESC LIMIT 7")
_select("o3_two_bounds_limit", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 500 AND o_orderkey > 90 LIMIT 7;", "SELECT o_orderkey FROM ORDERS WHERE o_orderkey <= 500 AND o_orderkey > 90 ORDER BY 1 LIMIT 7")
_select("o4_limit_offset", "orders", "SELECT o_orderkey FROM orders LIMIT 10 OFFSET 5;", "SELECT o_orderkey FROM ORDERS ORDER BY 1 LIMIT 10 OFFSET 5")


@_query("s6_point_read", f"{_ALL} WHERE o_orderkey = 33")
def _s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "s6")
    row = engine.select("orders", [33])
    return spark.createDataFrame([row] if row else [], engine.table("orders").schema)


@_query("s7_seek", "SELECT o_orderkey, o_custkey FROM ORDERS WHERE o_orderkey >= 1200")
def _s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "s7").seek("orders", [1200]).select("o_orderkey", "o_custkey")


@_query("s3_range_api", "SELECT o_custkey, o_orderkey FROM ORDERS WHERE o_custkey > 20 AND o_custkey <= 60")
def _s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "s3").scan("orders", lower=(">", [20]), upper=("<=", [60]), index=1, descending=True).select("o_custkey", "o_orderkey")


# changes: the table after the statement

_CREATE = "CREATE TABLE t (k int64, v string, n int64, PRIMARY KEY (k), INDEX (n));"


def _small(spark: SparkSession, tag: str) -> Engine:
    engine = Engine.scratch(spark, tag)
    engine.sql(_CREATE)
    for k in range(6):
        engine.sql(f"INSERT INTO t VALUES ({k}, 'v{k}', {k % 3});")
    return engine


_SMALL = "SELECT i AS k, 'v' || i AS v, i % 3 AS n FROM range(6) r(i)"


@_query("m1_create_insert", f"{_SMALL} UNION ALL SELECT -9223372036854775808, 'it''s', 9")
def _m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "m1")
    engine.sql("INSERT INTO t VALUES (-9223372036854775808, 'it\\'s', +9);")
    return engine.table("t")


@_query("m2_drop_and_recreate", "SELECT CAST(1 AS BIGINT) AS a")
def _m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "m2")
    engine.sql("DROP TABLE t;")
    engine.sql("CREATE TABLE t (a int64, PRIMARY KEY (a));")
    engine.sql("INSERT INTO t VALUES (1);")
    return engine.table("t")


@_query("m3_insert_existing_key", "SELECT CAST(0 AS BIGINT) AS existing, CAST(1 AS BIGINT) AS fresh")
def _m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "m3")
    counts = [engine.sql(f"INSERT INTO orders VALUES ({k}, 1, 'O', 1, 1, 'x');").rows_affected for k in (engine.table("orders").first().o_orderkey, -5)]
    return spark.createDataFrame([counts], "existing long, fresh long")


@_query("m4_update", "SELECT o_orderkey, CASE WHEN o_custkey < 50 THEN o_totalprice - o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_custkey < 50 THEN o_custkey ELSE o_totalprice END AS o_totalprice, o_day, CASE WHEN o_custkey < 50 THEN o_orderstatus || '!' ELSE o_orderpriority END AS o_orderpriority FROM ORDERS")
def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "m4")
    engine.sql("UPDATE orders SET o_custkey = o_totalprice - o_custkey, o_totalprice = o_custkey, o_orderpriority = o_orderstatus + '!' WHERE o_custkey < 50;")
    return engine.table("orders")


@_query("m4_rows_affected", "SELECT count(*) AS n FROM ORDERS WHERE o_custkey < 50 AND o_orderstatus <> 'O'")
def _m4n(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _orders(spark, sf_dir, "m4n").sql("UPDATE orders SET o_orderstatus = 'O' WHERE o_custkey < 50;").rows_affected
    return spark.createDataFrame([(n,)], "n long")


@_query("m5_delete", f"{_ALL} WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 5000000)")
def _m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "m5")
    engine.sql("DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 5000000;")
    return engine.table("orders")


@_query("m7_upsert_frame", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey <= 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_day, o_orderpriority FROM ORDERS UNION ALL SELECT -o_orderkey, o_custkey, 'X', o_totalprice, o_day, o_orderpriority FROM ORDERS WHERE o_orderkey <= 100 AND o_orderkey > 0")
def _m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "m7")
    some = engine.table("orders").where("o_orderkey <= 100").withColumn("o_orderstatus", F.lit("X"))
    engine.upsert_df("orders", some.unionByName(some.where("o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))))
    return engine.table("orders")


@_query("m7_update_delete_frames", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_day, o_orderpriority FROM ORDERS WHERE o_custkey % 2 = 0")
def _m7u(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "m7u")
    rows = engine.table("orders")
    engine.update_df("orders", rows.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Y")))
    engine.delete_df("orders", rows.where("o_custkey % 2 <> 0").select("o_orderkey"))
    return engine.table("orders")


@_query("m7_insert_frame", "SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _m7i(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.scratch(spark, "m7i")
    engine.create_table("t", [("k", "int64"), ("n", "int64")], ["k"])
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    engine.insert_df("t", counts)
    engine.insert_df("t", counts.withColumn("n", F.lit(-1).cast("long")))  # every key is there
    return engine.table("t")


# transactions

@_query("t2_read_your_writes", "SELECT CAST(1 AS BIGINT) AS inside, CAST(0 AS BIGINT) AS outside")
def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "t2")
    with engine.transaction() as tx:
        tx.sql("INSERT INTO t VALUES (50, 'new', 50);")
        inside = len(tx.sql("SELECT k FROM t WHERE k = 50;").rows())
        outside = len(engine.sql("SELECT k FROM t WHERE k = 50;").rows())
    return spark.createDataFrame([(inside, outside)], "inside long, outside long")


@_query("t4_first_committer_wins", "SELECT CAST(1 AS BIGINT) AS conflict, 'first' AS v, 'kept' AS other")
def _t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "t4")
    one, two, three = engine.transaction(), engine.transaction(), engine.transaction()
    one.sql("UPDATE t SET v = 'first' WHERE k = 1;")
    two.sql("UPDATE t SET v = 'second' WHERE k = 1;")
    three.sql("UPDATE t SET v = 'kept' WHERE k = 2;")
    one.commit()
    try:
        two.commit()
        conflict = 0
    except TxConflict:
        conflict = 1
    three.commit()
    return spark.createDataFrame([(conflict, engine.select("t", [1])[1], engine.select("t", [2])[1])], "conflict long, v string, other string")


@_query("t5_nested", f"SELECT * FROM ({_SMALL}) WHERE k <> 1 UNION ALL SELECT 7, 'inner', 7")
def _t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "t5")
    with engine.transaction() as tx:
        tx.sql("DELETE FROM t WHERE k = 1;")
        with tx.begin() as inner:
            inner.sql("INSERT INTO t VALUES (7, 'inner', 7);")
        lost = tx.begin()
        lost.sql("DELETE FROM t;")
        lost.abort()
    return engine.table("t")


@_query("t1_pinned_version", _SMALL)
def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "t1")
    before = engine.table("t")
    engine.sql("DELETE FROM t;")
    engine.compact("t")
    return before


# versions and maintenance

@_query("i1_merge_on_read", "SELECT o_orderkey, CASE WHEN o_orderkey <= 200 THEN o_custkey + 2 WHEN o_orderkey <= 400 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM ORDERS WHERE o_orderkey > 50")
def _i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "i1")
    engine.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderkey <= 400;")
    engine.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderkey <= 200;")
    engine.sql("DELETE FROM orders WHERE o_orderkey <= 50;")
    return engine.table("orders").select("o_orderkey", "o_custkey")


@_query("i4_fold_compact_vacuum", ORACLE["i1_merge_on_read"])
def _i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "i4")
    engine.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderkey <= 400;")
    engine.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderkey <= 200;")
    engine.fold("orders")
    engine.sql("DELETE FROM orders WHERE o_orderkey <= 50;")
    engine.compact("orders")
    engine.vacuum()
    return engine.table("orders").select("o_orderkey", "o_custkey")


@_query("k9_export_restore", f"{_ALL} WHERE o_orderkey > 10")
def _k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir, "k9")
    engine.sql("DELETE FROM orders WHERE o_orderkey <= 10;")
    copy = f"{engine.storage.files.root}-copy"
    engine.export(copy)
    return Engine(spark, copy).table("orders")


# the key-value store, filled from a table: keys and values are text in UTF-8

def _kv(spark: SparkSession, sf_dir: str, tag: str) -> Engine:
    engine = Engine.scratch(spark, tag)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    engine.kv.upsert_df(parts.select(F.lpad(F.col("p_partkey").cast("string"), 16, "0").cast("binary"), F.col("p_name").cast("binary")))
    return engine


_PARTS = "(SELECT lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS key, p_name AS value FROM part)"
_text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
_key = lambda n: f"{n:016d}".encode()


@_query("s9_kv_get_many", f"SELECT key, value FROM {_PARTS} WHERE CAST(key AS BIGINT) % 10 = 0")
def _s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _kv(spark, sf_dir, "s9")
    return _text(engine.kv.get_many(engine.kv.items().where("CAST(CAST(key AS STRING) AS BIGINT) % 10 = 0").select("key").unionAll(spark.createDataFrame([(b"missing",)], "key binary"))))


@_query("s10_kv_seek", f"SELECT key, value FROM {_PARTS} WHERE key >= '{150:016d}'")
def _s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_kv(spark, sf_dir, "s10").kv.seek(_key(150)))


@_query("s11_kv_last", f"SELECT key, value FROM {_PARTS} ORDER BY key DESC LIMIT 1")
def _s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_kv(spark, sf_dir, "s11").kv.last().limit(1))


@_query("s12_kv_range", f"SELECT key, value FROM {_PARTS} WHERE key BETWEEN '{20:016d}' AND '{140:016d}'")
def _s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_kv(spark, sf_dir, "s12").kv.range(_key(140), _key(20), descending=True))


@_query("s13_kv_items", f"SELECT key, value FROM {_PARTS}")
def _s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_kv(spark, sf_dir, "s13").kv.items())


@_query("s14_kv_scan_keys_only", f"SELECT key FROM {_PARTS} WHERE key <= '{100:016d}' ORDER BY key DESC LIMIT 25")
def _s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _kv(spark, sf_dir, "s14")
    engine.kv.put(b"\x00stratakeep\x00own", b"hidden")
    return _text(engine.kv.scan(start=_key(100), descending=True, limit=25, keys_only=True))


@_query("m9_kv_modes", "SELECT * FROM (VALUES (0, 'update', FALSE), (1, 'insert', TRUE), (2, 'insert', FALSE), (3, 'update', TRUE), (4, 'upsert', TRUE), (5, 'upsert', FALSE), (6, 'delete', TRUE), (7, 'delete', FALSE)) t(step, mode, changed)")
def _m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = Engine.scratch(spark, "m9").kv
    steps = [("update", b"v1"), ("insert", b"v1"), ("insert", b"xx"), ("update", b"yy"), ("upsert", b"zz"), ("upsert", b"zz")]
    rows = [(i, mode, kv.put(b"k1", value, mode)) for i, (mode, value) in enumerate(steps)]
    rows += [(6 + i, "delete", kv.delete(b"k1")) for i in range(2)]
    return spark.createDataFrame(rows, "step int, mode string, changed boolean")


@_query("m10_kv_batch", f"SELECT key, CASE WHEN CAST(key AS BIGINT) % 3 = 1 THEN 'second' ELSE value END AS value FROM {_PARTS} WHERE CAST(key AS BIGINT) % 3 <> 2")
def _m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _kv(spark, sf_dir, "m10")
    n = F.col("key").cast("string").cast("long")
    base = engine.kv.items()
    command = lambda turn, op, value, mode, which: base.where(n % 3 == which).select((n * 10 + turn).alias("seq"), F.lit(op).alias("op"), "key", F.lit(value).cast("binary").alias("value"), F.lit(mode).alias("mode"))
    # of every three keys: one is overwritten twice, one is put and deleted, one is tried to insert
    parts = [command(0, "put", "first", "upsert", 1), command(1, "put", "second", "update", 1), command(2, "put", "third", "insert", 1), command(0, "put", "x", "upsert", 2), command(1, "del", None, None, 2), command(0, "put", "x", "insert", 0)]
    commands = parts[0]
    for part in parts[1:]:
        commands = commands.unionByName(part)
    engine.kv.apply_df(commands)
    return _text(engine.kv.items())


@_query("k8_dump_restore", f"SELECT key, value FROM {_PARTS} WHERE key <= '{300:016d}'")
def _k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, other, stream = _kv(spark, sf_dir, "k8"), Engine.scratch(spark, "k8-copy"), io.BytesIO()
    dump.dump_kv(engine.kv, stream, stop=_key(300))
    stream.seek(0)
    dump.restore_kv(other.kv, stream)
    return _text(other.kv.items())


@_query("s21_generator", "SELECT lpad(CAST(i AS VARCHAR), 16, '0') AS key, repeat('abcdefghijklmnopqrstuvwxyz', 5)[1:128] AS value FROM range(5000) r(i)")
def _s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(generated(spark, 5000, 128))


def _observed(name: str, want: dict[str, object]) -> Callable:
    """A query of named observations (all as text) and the values that they must have."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in want.items())

    def add(f: Callable[[SparkSession], dict]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame([(k, str(v)) for k, v in f(spark).items()], "what string, value string")

        return _query(name, f"SELECT * FROM (VALUES {rows}) t(what, value)")(run)

    return add


def _error(run: Callable) -> str:
    """The name of the error that a call ends in."""
    try:
        run()
    except StrataError as e:
        return type(e).__name__
    return "none"


@_query("t5_siblings", f"SELECT * FROM ({_SMALL}) WHERE k <> 2 UNION ALL SELECT 7, 'first', 7 UNION ALL SELECT 8, 'second', 8")
def _t5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "t5s")
    with engine.transaction() as tx:
        first, second, third = tx.begin(), tx.begin(), tx.begin()
        first.insert("t", [7, "first", 7])
        second.insert("t", [8, "second", 8])
        second.sql("delete from t where k = 2;")
        third.insert("t", [9, "third", 9])
        first.commit()
        third.abort()
        second.commit()
    return engine.table("t")


@_observed("i6_kv_auto_fold", {"deltas stay bounded": True, "pairs": 30, "last value": "v29", "batches stay bounded": True})
def _i6(spark: SparkSession) -> dict:
    engine = Engine.scratch(spark, "i6")
    engine.fold_after = 4
    deltas = []
    for i in range(30):
        engine.kv.put(f"k{i:02}".encode(), f"v{i}".encode())
        deltas.append(len(engine.storage.head().tables[KV_TABLE].deltas))
    bounded = max(deltas) <= 4
    for i in range(6):
        with engine.transaction() as tx:
            tx.upsert(KV_TABLE, [b"k00", f"again{i}".encode()])
    return {"deltas stay bounded": bounded, "pairs": engine.kv.items().count(), "last value": engine.kv.get(b"k29").decode(), "batches stay bounded": len(engine.storage.head().tables[KV_TABLE].deltas) <= 4}


@_observed("k3_checksummed_manifest", {"intact": "none", "one byte changed": "CorruptStore", "cut short": "CorruptStore"})
def _k3(spark: SparkSession) -> dict:
    stored = Manifest(3).to_bytes()
    turned = bytes([stored[0] ^ 1]) + stored[1:]
    return {"intact": _error(lambda: Manifest.from_bytes(stored)), "one byte changed": _error(lambda: Manifest.from_bytes(turned)), "cut short": _error(lambda: Manifest.from_bytes(stored[:-1]))}


@_observed("k4_k5_result_access", {"all rows": "[(1,), (2,), (3,)]", "streamed": "[(1,), (2,), (3,)]", "after close": "[]", "columns": "[(k, int64)]"})
def _k4(spark: SparkSession) -> dict:
    engine = _small(spark, "k4")
    ask = lambda: engine.sql("select k from t where k <= 3 and k >= 1;")
    streamed, closed = ask(), ask()
    closed.close()
    closed.close()
    columns = ", ".join(f"({n}, {t})" for n, t in ask().columns)
    return {"all rows": ask().rows(), "streamed": list(streamed), "after close": list(closed), "columns": f"[{columns}]"}


@_observed("x18_depth_guards", {"parentheses": "ParseError", "long sum": "AnalysisError", "within": 1, "divisions": "[(-7,)]"})
def _x18(spark: SparkSession) -> dict:
    engine = _small(spark, "x18")
    deep = "select k from t where " + "(" * 3000 + "1" + ")" * 3000 + ";"
    long = "select " + "1+" * 3000 + "1 from t;"
    return {"parentheses": _error(lambda: engine.sql(deep)), "long sum": _error(lambda: engine.sql(long)), "within": len(engine.sql("select k from t where k = " + "0+" * 300 + "1;").rows()), "divisions": engine.sql("select -15" + "*2/2" * 300 + "/2 from t where k = 1;").rows()}


@_observed("x19_x20_headers_and_types", {"headers": "k|(k + 1)|(k = 1)", "types": "int64|int64|int64"})
def _x19(spark: SparkSession) -> dict:
    columns = _small(spark, "x19").sql("select k, k+1, k = 1 from t;").columns
    return {"headers": "|".join(n for n, _ in columns), "types": "|".join(t for _, t in columns)}


@_observed("p3_p4_projection_after_offset", {"rows": "[(6,), (3,)]", "columns without rows": "k"})
def _p3(spark: SparkSession) -> dict:
    engine = _small(spark, "p3")
    # 6 / (k - 1) fails on k = 1, which the offset passes over
    rows = engine.sql("select 6 / (k - 1) from t where k >= 1 and k <= 3 limit 2 offset 1;").rows()
    return {"rows": rows, "columns without rows": engine.sql("select k from t where k = 99;").columns[0][0]}


@_observed("t6_t7_finished_transactions", {"write after commit": "TxDone", "commit twice": "TxDone", "abort after commit": "TxDone", "statement commits itself": 1, "closed engine": "EngineClosed"})
def _t6(spark: SparkSession) -> dict:
    engine = _small(spark, "t6")
    tx = engine.transaction()
    tx.sql("delete from t where k = 1;")
    tx.commit()
    out = {"write after commit": _error(lambda: tx.sql("delete from t where k = 2;")), "commit twice": _error(tx.commit), "abort after commit": _error(tx.abort)}
    out["statement commits itself"] = engine.sql("delete from t where k = 2;").rows_affected
    engine.close()
    return out | {"closed engine": _error(lambda: engine.sql("select k from t;"))}


@_observed("i9_i10_cache_and_bloom", {"same frame": True, "follows a change": True, "found": True, "absent": True})
def _i9(spark: SparkSession) -> dict:
    engine = _small(spark, "i9")
    first = engine.cached("t")
    same, n = engine.cached("t") is first, first.count()
    engine.sql("delete from t where k = 1;")
    follows = engine.cached("t").count() == n - 1
    engine.compact("t", bloom=True)
    return {"same frame": same, "follows a change": follows, "found": engine.select("t", [2]) is not None, "absent": engine.select("t", [1]) is None}


@_observed("a4_errors", {"no table": "AnalysisError", "no column": "AnalysisError", "bad text": "ParseError", "division": "ExecutionError", "reserved key": "ReservedKey", "missing key": "KeyNotFound", "mode": "InvalidArgument"})
def _a4(spark: SparkSession) -> dict:
    engine = _small(spark, "a4")
    division = lambda: engine.sql("select 1 / (k - 1) from t where k = 1;").rows()
    return {
        "no table": _error(lambda: engine.sql("select k from zz;")), "no column": _error(lambda: engine.sql("select zz from t;")), "bad text": _error(lambda: engine.sql("selekt k from t;")),
        "division": _error(division), "reserved key": _error(lambda: engine.kv.put_checked(b"", b"v")), "missing key": _error(lambda: engine.kv.need(b"none")), "mode": _error(lambda: engine.kv.put(b"k", b"v", "merge")),
    }


@_observed("s8_m8_index_upkeep", {"moved": "[(0, 10), (1, 11), (2, 12)]", "left": "[(5,), (4,), (3,)]"})
def _s8(spark: SparkSession) -> dict:
    engine = _small(spark, "s8")
    engine.sql("update t set n = n + 10 where k < 3;")
    return {"moved": engine.sql("select k, n from t where n >= 10;").rows(), "left": engine.sql("select k from t where n <= 2;").rows()}


@_observed("s15_a7_command_line", {"put": "0 updated", "put again": "0 unchanged", "range": "0 a\t1|b\t2", "range down": "0 b\t2|a\t1", "missing key": "1 ", "statement": "0 OK, 0 rows affected", "tables": "0 u"})
def _s15(spark: SparkSession) -> dict:
    root = Engine.scratch(spark, "s15").storage.files.root

    def call(*argv: str) -> str:
        out = io.StringIO()
        code = command_line(["--root", root, *argv], spark, out)
        return f"{code} {'|'.join(out.getvalue().splitlines())}"

    first, again, _ = call("kv", "put", "a", "1"), call("kv", "put", "a", "1"), call("kv", "put", "b", "2")
    out = {"put": first, "put again": again, "range": call("kv", "range", "a", "b"), "range down": call("kv", "range", "b", "a", "--descending"), "missing key": call("kv", "get", "zz")}
    return out | {"statement": call("sql", "create table u (k int64, primary key (k))"), "tables": call("tables")}


@_observed("s18_reopen", {"committed": "[(0,), (1,), (2,), (3,), (4,), (5,)]", "staged only": "None"})
def _s18(spark: SparkSession) -> dict:
    engine = _small(spark, "s18")
    engine.transaction().insert("t", [9, "left open", 9])
    again = Engine(spark, engine.storage.files.root)
    return {"committed": again.sql("select k from t;").rows(), "staged only": again.select("t", [9])}


@_observed("k6_k7_rendering", {"table": "+---+----+/| k | v  |/+---+----+/| 1 | v1 |/+---+----+/(1 row)/", "statement": "OK, 1 row affected/", "json": '{"columns":[{"name":"k","type":"int64"},{"name":"v","type":"string"}],"rows":[[1,"v1"]],"rows_affected":0}/'})
def _k6(spark: SparkSession) -> dict:
    engine = _small(spark, "k6")
    ask = lambda style: engine.sql("select k, v from t where k = 1;").render(style).replace("\n", "/")
    return {"table": ask("table"), "statement": engine.sql("delete from t where k = 5;").render().replace("\n", "/"), "json": ask("json")}


@_observed("i5_merge_by_size", {"large delta stays": True, "deltas stay bounded": True, "pairs": 20_010})
def _i5(spark: SparkSession) -> dict:
    engine = Engine.scratch(spark, "i5")
    engine.fold_after = 4
    engine.kv.upsert_df(generated(spark, 20_000, 16))
    deltas = lambda: engine.storage.head().tables[KV_TABLE].deltas
    large = deltas()[0]
    for i in range(10):
        engine.kv.put(f"k{i}".encode(), b"small")
    return {"large delta stays": deltas()[0] == large, "deltas stay bounded": len(deltas()) <= 4, "pairs": engine.kv.items().count()}


@_observed("i8_readers_keep_their_files", {"reader": 6, "old version": 6, "newest": 5})
def _i8(spark: SparkSession) -> dict:
    engine = _small(spark, "i8")
    reader, version = engine.table("t"), engine.storage.head().version
    engine.sql("delete from t where k = 5;")
    engine.compact("t")
    engine.vacuum(keep_versions=3)
    return {"reader": reader.count(), "old version": engine.table("t", version).count(), "newest": engine.table("t").count()}


@_observed("a2_a8_results_and_statements", {"columns of a statement": "[]", "rows of a statement": "[]", "affected": 2, "ended": "select k from t;", "blank": ""})
def _a2(spark: SparkSession) -> dict:
    done = _small(spark, "a2").sql("update t set v = 'w' where k >= 4;")
    return {"columns of a statement": done.columns, "rows of a statement": list(done), "affected": done.rows_affected, "ended": normalize(" select k from t "), "blank": normalize("  ")}


_ABSENT = (
    "select k from t order by k;", "select k from t group by k;", "select count(*) from t;", "select distinct k from t;", "select k from t join u;", "select k as x from t;", "select k from t where k in (1);",
    "select k from t where k between 1 and 2;", "select null from t;", "select 1.5 from t;", "with u as (select k from t) select k from u;", "select k from t union select k from t;", "alter table t add z int64;", "select k from t where s like 'a';",
)


@_query("s213_absent_constructs", "SELECT * FROM (VALUES " + ", ".join(f"({i}, TRUE)" for i in range(len(_ABSENT))) + ") t(statement, refused)")
def _absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _small(spark, "absent")
    return spark.createDataFrame([(i, _error(lambda s=s: engine.sql(s)) != "none") for i, s in enumerate(_ABSENT)], "statement int, refused boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key range with an expression, in key order."""
    engine = _orders(spark, sf_dir, "flagship")
    return engine.sql("SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200 LIMIT 10;").dataframe
