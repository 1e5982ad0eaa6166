"""Queries of the operators against their SQL, as the driver compares them."""

import duckdb
import pytest

from stratakeep.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_ten_operators_are_registered():
    numbers = [int(n[2:].split("_")[0]) for n in Q.queries()]
    assert sorted(numbers) == list(range(1, 11))
