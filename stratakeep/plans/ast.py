"""Syntax trees of the dialect: expressions and the six statements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

INT, STR, BYTES = "int64", "string", "bytes"
MAX_DEPTH = 1000

ARITHMETIC = ("+", "-", "*", "/")
COMPARISONS = ("=", "!=", "<=", ">=", "<", ">")
LOGIC = ("AND", "OR")


@dataclass(frozen=True)
class Name:
    """A column."""

    name: str


@dataclass(frozen=True)
class Lit:
    value: int | str

    @property
    def type(self) -> str:
        return INT if isinstance(self.value, int) else STR


@dataclass(frozen=True, eq=False)
class Unary:
    """``op`` is "-" or "NOT"."""

    op: str
    kid: Expr


@dataclass(frozen=True, eq=False)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True, eq=False)
class Tuple:
    kids: tuple[Expr, ...]


@dataclass(frozen=True)
class Star:
    """All columns; only in a select list."""


Expr = Name | Lit | Unary | Binary | Tuple | Star


@dataclass
class Select:
    table: str
    items: list[Expr]
    where: Expr | None = None
    limit: int | None = None
    offset: int = 0


@dataclass
class CreateTable:
    table: str
    columns: list[tuple[str, str]]
    pkey: list[str]
    indexes: list[list[str]] = field(default_factory=list)


@dataclass
class DropTable:
    table: str


@dataclass
class Insert:
    table: str
    values: list[int | str]


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, Expr]]
    where: Expr | None = None


@dataclass
class Delete:
    table: str
    where: Expr | None = None


Statement = Select | CreateTable | DropTable | Insert | Update | Delete


def spine(node: Expr, ops: tuple[str, ...]) -> tuple[Expr, list[tuple[str, Expr]]]:
    """The leftmost operand of a left-leaning chain of ``ops``, and (op, operand) from there on."""
    rest = []
    while isinstance(node, Binary) and node.op in ops:
        rest.append((node.op, node.right))
        node = node.left
    return node, rest[::-1]


def kids(node: Expr) -> tuple[Expr, ...]:
    if isinstance(node, Unary):
        return (node.kid,)
    if isinstance(node, Binary):
        return node.left, node.right
    return node.kids if isinstance(node, Tuple) else ()


def walk(node: Expr) -> Iterator[tuple[Expr, int]]:
    """Every node with its depth; no recursion, so chains of any length are fine."""
    todo = [(node, 0)]
    while todo:
        now, depth = todo.pop()
        yield now, depth
        todo += [(kid, depth + 1) for kid in kids(now)]


def same(a: Expr | None, b: Expr | None) -> bool:
    """Structural equality."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if type(x) is not type(y) or getattr(x, "op", None) != getattr(y, "op", None):
            return False
        if isinstance(x, (Name, Lit)) and (x != y or type(getattr(x, "value", 0)) is not type(getattr(y, "value", 0))):
            return False
        if x is not None:
            below = kids(x), kids(y)
            if len(below[0]) != len(below[1]):
                return False
            todo += zip(*below, strict=True)
    return True
