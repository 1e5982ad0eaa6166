import pytest

from stratakeep.plans.ordering import conjuncts, plan_order
from stratakeep.plans.parser import parse_expr
from stratakeep.sources.catalog import build_schema

SCHEMA = build_schema("t", [("a", "int64"), ("b", "int64"), ("c", "string"), ("d", "string")], ["d"], [["b"], ["a", "d"]])


@pytest.mark.parametrize(
    "where, index, descending, served",
    [
        ("d = 'x'", 0, False, 1), ("'x' = d", 0, False, 1), ("b = 1", 1, False, 1), ("a = 1 and d = 'x'", 2, False, 2), ("b = 1 and d = 'x'", 1, False, 2), ("c = 'x'", 0, False, 0),
        ("a > 1", 2, False, 1), ("a < 1", 2, True, 1), ("1 > a", 2, True, 1), ("a <= 1 and a > 0", 2, False, 2), ("a > 0 and a <= 1", 2, False, 2), ("(a, d) <= (1, 'x')", 2, True, 1), ("(a, d) > (1, 'x') and a < 5", 2, False, 2),
        ("a < -1", 0, False, 0), ("a = -1", 0, False, 0), ("(a, b) = (1, 2)", 0, False, 0), ("a < 1 or a > 5", 0, False, 0), ("not a < 1", 0, False, 0), ("a = '1'", 0, False, 0), ("a < b", 0, False, 0),
        ("b < 5 and c = 'x' and a > 1 and a < 4", 1, True, 1), ("b < 5 and d = 'x'", 0, False, 1), ("a > 1 and a > 2", 2, False, 1), ("(a, b) < (1, 2)", 0, False, 0), ("(a, d, b) < (1, 'x', 2)", 0, False, 0), ("a = 1 and a = 2", 2, False, 1),
    ],
)
def test_rules(where, index, descending, served):
    order = plan_order(SCHEMA, parse_expr(where))
    assert (order.index, order.descending, len(order.served)) == (index, descending, served)
    assert len(order.served) + len(order.residual) == len(conjuncts(parse_expr(where)))


def test_indexes_end_with_the_primary_key():
    assert SCHEMA.indexes == ((3,), (1, 3), (0, 3))


def test_conjuncts_beyond_the_limit_stay_together():
    parts = conjuncts(parse_expr(" and ".join(f"a = {i}" for i in range(100))))
    assert len(parts) == 32
    assert len(conjuncts(parse_expr(" and ".join(f"a = {i}" for i in range(32))))) == 32


def test_no_condition():
    order = plan_order(SCHEMA, None)
    assert (order.index, order.descending, order.indexed) == (0, False, False)
