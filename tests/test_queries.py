"""Every query of the engine against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

from stratakeep import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = Q.QUERIES[name](spark, SF)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    want = duck.execute(Q.ORACLE[name])
    assert got == normal([d[0] for d in want.description], want.fetchall())
