"""The test tables as tables of the dialect, which knows 64-bit integers and strings only.

Money becomes cents, times become days or microseconds since 1970; lists have no counterpart and
are left out.  Nothing is copied: the expressions run where the Parquet files are read.
"""

from __future__ import annotations

from ..engine import Engine
from ..plans.ast import INT, STR

_INT = lambda name: (name, INT, f"CAST({name} AS BIGINT)")
_STR = lambda name: (name, STR, name)
_CENTS = lambda name: (name, INT, f"CAST(ROUND({name} * 100) AS BIGINT)")
_DAY = lambda name, new: (new, INT, f"CAST(UNIX_DATE(CAST({name} AS DATE)) AS BIGINT)")

#: name: (columns, primary key, secondary orderings)
TABLES = {
    "region": ([_INT("r_regionkey"), _STR("r_name")], ["r_regionkey"], []),
    "nation": ([_INT("n_nationkey"), _STR("n_name"), _INT("n_regionkey")], ["n_nationkey"], [["n_regionkey"]]),
    "customer": ([_INT("c_custkey"), _STR("c_name"), _INT("c_nationkey"), _CENTS("c_acctbal"), _STR("c_mktsegment")], ["c_custkey"], [["c_nationkey"]]),
    "supplier": ([_INT("s_suppkey"), _STR("s_name"), _INT("s_nationkey"), _CENTS("s_acctbal")], ["s_suppkey"], []),
    "part": ([_INT("p_partkey"), _STR("p_name"), _STR("p_brand"), _STR("p_type"), _INT("p_size"), _CENTS("p_retailprice")], ["p_partkey"], [["p_brand", "p_size"]]),
    "orders": ([_INT("o_orderkey"), _INT("o_custkey"), _STR("o_orderstatus"), _CENTS("o_totalprice"), _DAY("o_orderdate", "o_day"), _STR("o_orderpriority")], ["o_orderkey"], [["o_custkey"], ["o_day"]]),
    "lineitem": (
        [_INT("l_orderkey"), _INT("l_linenumber"), _INT("l_partkey"), _INT("l_suppkey"), _DAY("l_shipdate", "l_ship_day"), _INT("l_quantity"), _CENTS("l_extendedprice"), _CENTS("l_discount"), _CENTS("l_tax"), _STR("l_returnflag"), _STR("l_linestatus")],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_ship_day"],
        [["l_partkey"]],
    ),
    "events": ([_INT("event_id"), ("ts_micros", INT, "UNIX_MICROS(CAST(ts AS TIMESTAMP))"), _INT("user_id"), _STR("event_type"), _CENTS("value"), _STR("props")], ["event_id"], [["user_id", "ts_micros"], ["event_type"]]),
    "documents": ([_INT("doc_id"), _STR("text"), _STR("lang"), _STR("source"), _INT("n_chars")], ["doc_id"], [["lang", "source"]]),
    "labels": ([_INT("doc_id"), _INT("quality"), _INT("toxic")], ["doc_id"], []),
    "pages": ([_INT("page_id"), _STR("url"), _STR("html")], ["page_id"], []),
    "benchmark": ([_INT("item_id"), _STR("text")], ["item_id"], []),
    "conversations": ([_INT("conv_id"), _INT("turn"), _STR("role"), _STR("text")], ["conv_id", "turn"], [["role"]]),
    "embeddings": ([_INT("vec_id"), _INT("label")], ["vec_id"], [["label"]]),
}


def register(engine: Engine, sf_dir: str, *names: str) -> Engine:
    for name in names or TABLES:
        columns, pkey, indexes = TABLES[name]
        engine.register_parquet(name, f"{sf_dir}/{name}.parquet", columns, pkey, indexes)
    return engine
