"""Types of expressions, checked before anything runs; the dialect never coerces."""

from __future__ import annotations

from ..errors import AnalysisError
from ..sources.catalog import Schema
from . import ast as A


def check_depth(node: A.Expr) -> None:
    """Chains of operators count too: each step of one is a level."""
    if any(depth > A.MAX_DEPTH for _, depth in A.walk(node)):
        raise AnalysisError("expression is nested too deeply")


def type_of(node: A.Expr, schema: Schema) -> str:
    """int64 or string; comparisons and logic give int64."""
    if isinstance(node, A.Name):
        return schema.columns[schema.position(node.name)].type
    if isinstance(node, A.Lit):
        return node.type
    if isinstance(node, A.Tuple):
        raise AnalysisError("a tuple is not a value")
    if isinstance(node, A.Unary):
        if type_of(node.kid, schema) != A.INT:
            raise AnalysisError("bad unary op")
        return A.INT
    if isinstance(node, A.Star):
        raise AnalysisError("unsupported expression")
    if isinstance(node.left, A.Tuple) or isinstance(node.right, A.Tuple):
        return _tuples(node, schema)
    first, rest = A.spine(node, A.ARITHMETIC + A.COMPARISONS + A.LOGIC)
    if isinstance(first, A.Tuple):  # the chain starts with a comparison of tuples
        first, rest = A.Binary(rest[0][0], first, rest[0][1]), rest[1:]
    kind = type_of(first, schema)
    for op, kid in rest:
        if type_of(kid, schema) != kind:
            raise AnalysisError("binary op type mismatch")
        if op in A.COMPARISONS:
            kind = A.INT
        elif kind != A.INT and op != "+":
            raise AnalysisError("bad binary op")
    return kind


def _tuples(node: A.Binary, schema: Schema) -> str:
    if not (isinstance(node.left, A.Tuple) and isinstance(node.right, A.Tuple)):
        raise AnalysisError("cannot compare a tuple with a scalar")
    if node.op not in A.COMPARISONS:
        raise AnalysisError("a tuple is not a value")
    if len(node.left.kids) != len(node.right.kids):
        raise AnalysisError("tuple comparison arity mismatch")
    for x, y in zip(node.left.kids, node.right.kids, strict=True):
        if type_of(x, schema) != type_of(y, schema):
            raise AnalysisError("binary op type mismatch")
    return A.INT


def expand(items: list[A.Expr], schema: Schema) -> list[A.Expr]:
    """A select list with * written out."""
    out: list[A.Expr] = []
    for item in items:
        out += [A.Name(n) for n in schema.names] if isinstance(item, A.Star) else [item]
    if not out:
        raise AnalysisError("expect column list")
    return out


def check_where(where: A.Expr | None, schema: Schema) -> None:
    if where is not None:
        check_depth(where)
        if type_of(where, schema) != A.INT:
            raise AnalysisError("WHERE clause is not a boolean")


def check_assignments(assignments: list[tuple[str, A.Expr]], schema: Schema) -> dict[int, A.Expr]:
    """Column position to new value; of repeated assignments the last one counts."""
    out: dict[int, A.Expr] = {}
    for name, value in assignments:
        check_depth(value)
        at = schema.position(name)
        if type_of(value, schema) != schema.columns[at].type:
            raise AnalysisError("column type mismatch")
        if at in schema.pkey:
            raise AnalysisError("cannot update a primary key column")
        out[at] = value
    return out


def check_values(values: list | tuple, schema: Schema) -> None:
    """A row of literals must fit the declared columns, one for one."""
    kinds = {int: A.INT, str: A.STR, bytes: A.BYTES, bytearray: A.BYTES}
    if len(values) != len(schema.columns) or any(kinds.get(type(v)) != c.type for v, c in zip(values, schema.columns, strict=True)):
        raise AnalysisError("schema mismatch")
    if any(isinstance(v, int) and not -(1 << 63) <= v < 1 << 63 for v in values):
        raise AnalysisError("schema mismatch")
