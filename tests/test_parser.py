import random

import pytest

from stratakeep.errors import ParseError
from stratakeep.functions.render import header
from stratakeep.plans import ast as A
from stratakeep.plans.parser import parse_expr, parse_stmt


def test_statements():
    s = parse_stmt("SeLeCt a, b+1 fRoM t WHERE a=1 limit 3 OFFSET +2;")
    assert (s.table, s.limit, s.offset, [header(i) for i in s.items], header(s.where)) == ("t", 3, 2, ["a", "(b + 1)"], "(a = 1)")
    c = parse_stmt("create table t (index (b), a int64, primary key (a), b string, primary key (b));")
    assert (c.columns, c.pkey, c.indexes) == ([("a", "int64"), ("b", "string")], ["a", "b"], [["b"]])
    i = parse_stmt("""insert into t values (-1, +2, 'it\\'s', "q\\"", -9223372036854775808, 9223372036854775807);""")
    assert i.values == [-1, 2, "it's", 'q"', -(1 << 63), (1 << 63) - 1]
    u = parse_stmt("update t set a = b, b = a + 1 where (a, b) < (1, 2);")
    assert [(n, header(e)) for n, e in u.assignments] == [("a", "b"), ("b", "(a + 1)")] and header(u.where) == "((a, b) < (1, 2))"
    assert parse_stmt("delete from t ;").where is None
    assert parse_stmt("\n\tdrop\v\ftable t\r\n ;  ").table == "t"


@pytest.mark.parametrize(
    "text, shown",
    [
        ("a + b * c", "(a + (b * c))"), ("a - b - c", "((a - b) - c)"), ("a / b * c", "((a / b) * c)"), ("-a * b", "(-a * b)"), ("- - a", "--a"),
        ("a or b and c", "(a OR (b AND c))"), ("not a = b", "NOT (a = b)"), ("not a and b", "(NOT a AND b)"), ("a < b < c", "((a < b) < c)"), ("a <> 'x'", "(a != x)"),
        ("(a)", "a"), ("(a, b)", "(a, b)"), ("a+-b", "(a + -b)"), ("1 -- 2", "(1 - -2)"), ("d or c and not d = c", "(d OR (c AND NOT (d = c)))"),
    ],
)
def test_precedence(text, shown):
    assert header(parse_expr(text)) == shown


def test_keywords_serve_as_names_where_they_can():
    assert parse_stmt("select distinct from t;").items == [A.Name("distinct")]
    assert parse_stmt("select null, true from select;").table == "select"
    assert parse_stmt("select *, a, * from t;").items == [A.Star(), A.Name("a"), A.Star()]


@pytest.mark.parametrize(
    "text",
    [
        "FOOBAR;", "select from t where a=1;", "select a,b;", "select a from where a=1;", "insert into t (1, 2);", "insert into t values (1, 2)", "create table t (a int64, primary key (a))",
        "create table t (a float64, primary key (a));", "create table t (a INT64, primary key (a));", "update t where a=1;", "update t set where a=1;", "select a from t limit;", "select a from t limit -1;", "select a from t limit 'x';",
        "select a from t limit 1 offset;", "select a from t offset 1;", "drop table;", "", ";", "select a from t; x", "select a from t", "select a from t;;", "selecta from t;", "select a from t where;", "select () from t;", "select a, from t;",
        "select 9223372036854775808 from t;", "select -9223372036854775808 from t;", "insert into t values (9223372036854775808);", "insert into t values (- 1);", "insert into t values (a);", "insert into t values (1),(2);", "insert into t values (1,);",
        "select 'x from t;", "select 'a\\n' from t;", "select 1.5 from t;", "select a b from t;", "select a as b from t;", "select t.a from t;", "select f(a) from t;", "select a from t, u;", "select a from t join u;", "select a from t order by a;", "select a from t group by a;",
        "select a from t where a in (1);", "select a from t where a like 'x';", "select a from t where a between 1 and 2;", "select a % 2 from t;", "select a from t union select a from u;", "begin;", "alter table t;", "create index i on t (a);", "truncate t;",
        "insert into t (a) values (1);", "select a from t -- x\n;", "select a /* x */ from t;", "select é from t;", "create table t (a int64,);", "select case when a then b end from t;", "with x as (select a from t) select a from x;",
    ],
)
def test_rejections(text):
    with pytest.raises(ParseError):
        parse_stmt(text)


def test_depth():
    parse_expr("(" * 1000 + "1" + ")" * 1000)
    parse_expr("1" + "+1" * 5000)
    for text in ("(" * 1001 + "1" + ")" * 1001, "not " * 1001 + "a", "-" * 1001 + "a", "(" * 200_000):
        with pytest.raises(ParseError):
            parse_expr(text)


def test_never_anything_but_a_parse_error():
    rnd = random.Random(1)
    words = "select from where a b t * , ( ) ; = <> <= + - / 'x' \"y 12 and or not limit offset insert into values update set delete create table primary key index int64 string drop \\ é".split()
    for _ in range(3000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 14)))
        try:
            parse_stmt(text)
        except ParseError:
            pass
