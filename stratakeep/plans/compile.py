"""Checked expressions to Spark columns.

Arithmetic wraps at 64 bits, division truncates and fails on 0, nothing short-circuits.  Chains are
turned into balanced trees, which Spark resolves at any length; tuple comparisons are written out
as comparisons of their parts, which Parquet readers can prune by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Schema
from . import ast as A
from .ordering import Order

#: Divisions in one chain that are written out, each a level that Spark has to resolve; longer
#: chains run over an array of their operands, at one level whatever their length.
MAX_DIVISIONS = 60
DIVISION_BY_0 = "division by 0"
_BOOL = "bool"


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans made inside wrap on overflow; the mode stays with the plan, the setting doesn't."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def fallible(node: A.Expr) -> bool:
    return any(isinstance(n, A.Binary) and n.op == "/" for n, _ in A.walk(node))


def _balanced(items: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    while len(items) > 1:
        items = [join(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


class Compiler:
    """Compiles against the columns of a schema, under their stored names."""

    def __init__(self, schema: Schema):
        self.schema = schema

    def value(self, node: A.Expr) -> Column:
        """The expression as the int64 or string it stands for."""
        column, kind = self._any(node)
        return column.cast("long") if kind == _BOOL else column

    def condition(self, node: A.Expr) -> Column:
        column, kind = self._any(node)
        return column if kind == _BOOL else column != F.lit(0)

    def filter(self, order: Order) -> Column | None:
        """The whole WHERE clause.  What a key range answers is decided first, as it keeps other
        rows from ever reaching a residual that may fail."""
        served = [self.condition(c) for c in order.served]
        residual = [self.condition(c) for c in order.residual]
        if not served and not residual:
            return None
        join = lambda x, y: x & y
        if not any(fallible(c) for c in order.residual):
            return _balanced(served + residual, join)
        rest = _balanced([c.cast("long") for c in residual], lambda x, y: x.bitwiseAND(y)) != F.lit(0)
        if not served:
            return rest
        guard = _balanced(served, join)
        return guard & F.when(guard, rest).otherwise(F.lit(False))

    def _any(self, node: A.Expr) -> tuple[Column, str]:
        if isinstance(node, A.Name):
            at = self.schema.position(node.name)
            return F.col(f"c{at}"), self.schema.columns[at].type
        if isinstance(node, A.Lit):
            return (F.lit(node.value).cast("long"), A.INT) if node.type == A.INT else (F.lit(node.value), A.STR)
        if isinstance(node, A.Unary):
            return self._unary(node)
        if node.op in A.COMPARISONS:
            return self._comparison(node), _BOOL
        if node.op in A.LOGIC:
            return self._logic(node), _BOOL
        return self._arithmetic(node)

    def _unary(self, node: A.Unary) -> tuple[Column, str]:
        # only whether the number of signs is odd counts, beyond the first NOT
        kid, n = node.kid, 1
        while isinstance(kid, A.Unary) and kid.op == node.op:
            kid, n = kid.kid, n + 1
        if node.op == "-":
            return (-self.value(kid) if n % 2 else self.value(kid)), A.INT
        condition = self.condition(kid)
        return (~condition if n % 2 else condition), _BOOL

    def _arithmetic(self, node: A.Binary) -> tuple[Column, str]:
        if node.op in ("+", "-"):
            first, rest = A.spine(node, ("+", "-"))
            start, kind = self._any(first)
            if kind == A.STR:
                return F.concat(start, *[self.value(kid) for _, kid in rest]), A.STR
            parts = [self.value(first)] + [self.value(kid) if op == "+" else -self.value(kid) for op, kid in rest]
            return _balanced(parts, lambda x, y: x + y), A.INT
        first, rest = A.spine(node, ("*", "/"))
        if sum(op == "/" for op, _ in rest) > MAX_DIVISIONS:
            return self._run_over(first, rest), A.INT
        run = [self.value(first)]
        for op, kid in rest:
            if op == "*":
                run.append(self.value(kid))
            else:
                run = [_divide(_balanced(run, lambda x, y: x * y), self.value(kid))]
        return _balanced(run, lambda x, y: x * y), A.INT

    def _run_over(self, first: A.Expr, rest: list[tuple[str, A.Expr]]) -> Column:
        """A chain of products and divisions from left to right, as a fold of its operands."""
        steps = F.array(*[F.struct(F.lit(op == "/").alias("divides"), self.value(kid).alias("by")) for op, kid in rest])
        return F.aggregate(steps, self.value(first), lambda x, s: F.when(s["divides"], _divide(x, s["by"])).otherwise(x * s["by"]))

    def _comparison(self, node: A.Binary) -> Column:
        if not isinstance(node.left, A.Tuple):
            return _compare(node.op, self.value(node.left), self.value(node.right))
        pairs = [(self.value(x), self.value(y)) for x, y in zip(node.left.kids, node.right.kids, strict=True)]
        if node.op in ("=", "!="):
            equal = _balanced([x == y for x, y in pairs], lambda x, y: x & y)
            return equal if node.op == "=" else ~equal
        strict = node.op[0]
        out = _compare(node.op, *pairs[-1])
        for x, y in reversed(pairs[:-1]):
            out = _compare(strict, x, y) | ((x == y) & out)
        # implied, and what a reader can prune by
        return _compare(strict + "=", *pairs[0]) & out

    def _logic(self, node: A.Binary) -> Column:
        first, rest = A.spine(node, (node.op,))
        kids = [first, *(kid for _, kid in rest)]
        parts = [self.condition(k) for k in kids]
        if not any(fallible(k) for k in kids):
            return _balanced(parts, (lambda x, y: x & y) if node.op == "AND" else (lambda x, y: x | y))
        bits = [p.cast("long") for p in parts]
        both = (lambda x, y: x.bitwiseAND(y)) if node.op == "AND" else (lambda x, y: x.bitwiseOR(y))
        return _balanced(bits, both) != F.lit(0)


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _divide(x: Column, y: Column) -> Column:
    return F.when(y == F.lit(0), F.raise_error(F.lit(DIVISION_BY_0)).cast("long")).otherwise(F.call_function("div", x, y))


def ordered(df: DataFrame, schema: Schema, index: int = 0, descending: bool = False) -> DataFrame:
    """Rows in the order of one of the table's keys, which is total."""
    keys = [F.col(f"c{k}") for k in schema.indexes[index]]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])
