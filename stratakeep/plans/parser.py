"""Statement text to syntax tree: a tokeniser and a precedence climber.

Words are reserved only where the grammar asks for a keyword, so columns may be named like one.
The dialect is strict: whatever isn't in its grammar is a ``ParseError``.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from ..errors import ParseError
from . import ast as A

_TOKEN = re.compile(
    r"""[ \t\n\v\f\r]*(?:
        (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<int>[0-9]+)
      | (?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
      | (?P<mark><=|>=|!=|<>|[-+*/=<>(),;])
      | (?P<end>\Z)
    )""",
    re.X | re.S,
)
#: Binary operators by how tightly they bind; all group to the left.
_BINDING = {"OR": 1, "AND": 2, "=": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}
_NOT = 3
_TYPES = (A.INT, A.STR)
# a level of nesting takes three Python frames, and nesting is bounded by A.MAX_DEPTH
sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000))


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    start: int
    end: int


def _tokens(text: str) -> list[_Token]:
    out, at = [], 0
    while not out or out[-1].kind != "end":
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip(" \t\n\v\f\r")
            raise ParseError("string is not terminated" if rest[:1] in "'\"" else f"unexpected character {rest[:1]!r}")
        out.append(_Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
        at = m.end()
    return out


def _unquote(text: str) -> str:
    def plain(m: re.Match) -> str:
        if m[1] not in "'\"":
            raise ParseError("bad escape")
        return m[1]

    return re.sub(r"\\(.)", plain, text[1:-1], flags=re.S)


def _int(text: str) -> int:
    value = int(text)
    if not -(1 << 63) <= value < 1 << 63:
        raise ParseError("integer out of range")
    return value


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    @property
    def now(self) -> _Token:
        return self.tokens[self.at]

    def step(self) -> _Token:
        token = self.now
        self.at += 1
        return token

    def keyword(self, *words: str) -> bool:
        """Take the words if they all come next."""
        ahead = self.tokens[self.at : self.at + len(words)]
        if [t.text.upper() for t in ahead if t.kind == "word"] != list(words):
            return False
        self.at += len(words)
        return True

    def mark(self, text: str) -> bool:
        if self.now.kind == "mark" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.mark(mark):
            raise ParseError(f"expect {mark}")

    def name(self, what: str = "name") -> str:
        if self.now.kind != "word":
            raise ParseError(f"expect {what}")
        return self.step().text

    def commas(self, item) -> list:
        """Parenthesised list; may be empty, no trailing comma."""
        self.need("(")
        out = []
        while not self.mark(")"):
            if out:
                self.need(",")
            out.append(item())
        return out

    # values

    def value(self) -> int | str:
        token = self.step()
        if token.kind == "str":
            return _unquote(token.text)
        if token.kind == "int":
            return _int(token.text)
        if token.kind == "mark" and token.text in "+-" and self.now.kind == "int" and self.now.start == token.end:
            return _int(token.text + self.step().text)
        raise ParseError("expect value")

    # expressions

    def expression(self, least: int = 1) -> A.Expr:
        left = self.operand(least)
        while True:
            op = self.now.text.upper() if self.now.kind == "word" else self.now.text if self.now.kind == "mark" else ""
            binding = _BINDING.get(op, 0)
            if not binding or binding < least:
                break
            self.at += 1
            left = A.Binary("!=" if op == "<>" else op, left, self.expression(binding + 1))
        return left

    def nested(self, inner, *args):
        """Parentheses, NOT and minus are what nests; chains of operators don't."""
        self.depth += 1
        if self.depth > A.MAX_DEPTH:
            raise ParseError("expression is nested too deeply")
        out = inner(*args)
        self.depth -= 1
        return out

    def operand(self, least: int) -> A.Expr:
        if least <= _NOT and self.keyword("NOT"):
            return A.Unary("NOT", self.nested(self.expression, _NOT))
        if self.mark("-"):
            return A.Unary("-", self.nested(self.expression, 7))
        token = self.now
        if token.kind == "mark" and token.text == "(":
            kids = self.nested(self.commas, self.expression)
            if not kids:
                raise ParseError("empty tuple")
            return kids[0] if len(kids) == 1 else A.Tuple(tuple(kids))
        if token.kind == "word":
            return A.Name(self.step().text)
        return A.Lit(self.value())

    # statements

    def statement(self) -> A.Statement:
        for words, parse in (
            (("SELECT",), self.select), (("CREATE", "TABLE"), self.create), (("INSERT", "INTO"), self.insert),
            (("UPDATE",), self.update), (("DELETE", "FROM"), self.delete), (("DROP", "TABLE"), self.drop),
        ):
            if self.keyword(*words):
                out = parse()
                self.need(";")
                if self.now.kind != "end":
                    raise ParseError("trailing garbage after the statement")
                return out
        raise ParseError("unknown statement")

    def select(self) -> A.Select:
        items: list[A.Expr] = []
        while not self.keyword("FROM"):
            if items and not self.mark(","):
                raise ParseError("expect comma")
            items.append(A.Star() if self.mark("*") else self.expression())
        if not items:
            raise ParseError("expect column list")
        out = A.Select(self.name("table name"), items, self.where())
        if self.keyword("LIMIT"):
            out.limit = self.count()
            if self.keyword("OFFSET"):
                out.offset = self.count()
        return out

    def count(self) -> int:
        value = self.value()
        if not isinstance(value, int) or value < 0:
            raise ParseError("expect a non-negative integer")
        return value

    def where(self) -> A.Expr | None:
        return self.expression() if self.keyword("WHERE") else None

    def create(self) -> A.CreateTable:
        out = A.CreateTable(self.name("table name"), [], [])

        def item() -> None:
            if self.keyword("PRIMARY", "KEY"):
                out.pkey.extend(self.commas(self.name))
            elif self.keyword("INDEX"):
                out.indexes.append(self.commas(self.name))
            else:
                name, kind = self.name(), self.name()
                if kind not in _TYPES:
                    raise ParseError("unknown column type")
                out.columns.append((name, kind))

        self.commas(item)
        return out

    def insert(self) -> A.Insert:
        table = self.name("table name")
        if not self.keyword("VALUES"):
            raise ParseError("expect VALUES")
        return A.Insert(table, self.commas(self.value))

    def update(self) -> A.Update:
        table, out = self.name("table name"), []
        if not self.keyword("SET"):
            raise ParseError("expect SET")
        while not out or self.mark(","):
            column = self.name("column")
            self.need("=")
            out.append((column, self.expression()))
        return A.Update(table, out, self.where())

    def delete(self) -> A.Delete:
        return A.Delete(self.name("table name"), self.where())

    def drop(self) -> A.DropTable:
        return A.DropTable(self.name("table name"))


def parse_stmt(text: str) -> A.Statement:
    """One statement, which must take up the whole text."""
    return _Parser(text).statement()


def parse_expr(text: str) -> A.Expr:
    """One expression, which must take up the whole text."""
    parser = _Parser(text)
    out = parser.expression()
    if parser.now.kind != "end":
        raise ParseError("trailing garbage after the expression")
    return out
