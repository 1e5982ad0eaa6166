"""Table schemas: two column types, a primary key, declared secondary orderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import AnalysisError, CorruptStore
from ..plans.ast import BYTES, INT, STR, CreateTable

SCHEMA_VERSION = 1
MAX_INDEXES = 256
_SPARK = {INT: T.LongType(), STR: T.StringType(), BYTES: T.BinaryType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str


@dataclass(frozen=True)
class Schema:
    """``indexes[0]`` is the primary key; every other one ends with the key's remaining columns, so
    each is a total order.  Numbers are positions in ``columns``."""

    table: str
    columns: tuple[Column, ...]
    indexes: tuple[tuple[int, ...], ...]

    @property
    def pkey(self) -> tuple[int, ...]:
        return self.indexes[0]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def stored(self) -> list[str]:
        """Names in storage, which don't depend on how Spark compares names."""
        return [f"c{i}" for i in range(len(self.columns))]

    @property
    def key(self) -> list[str]:
        return [f"c{i}" for i in self.pkey]

    @property
    def rest(self) -> list[str]:
        return [c for c in self.stored if c not in self.key]

    def position(self, name: str) -> int:
        for i, column in enumerate(self.columns):
            if column.name == name:
                return i
        raise AnalysisError("unknown column")

    def spark(self, with_deleted: bool = False) -> T.StructType:
        fields = [T.StructField(f"c{i}", _SPARK[c.type], True) for i, c in enumerate(self.columns)]
        return T.StructType(fields + [T.StructField("deleted", T.BooleanType(), True)] * with_deleted)

    def to_json(self) -> dict:
        return {"version": SCHEMA_VERSION, "table": self.table, "columns": [[c.name, c.type] for c in self.columns], "indexes": [list(i) for i in self.indexes]}


def from_json(data: dict) -> Schema:
    """Check everything: a damaged schema must not be used."""
    try:
        if data["version"] != SCHEMA_VERSION:
            raise CorruptStore("unsupported schema version")
        out = Schema(data["table"], tuple(Column(n, t) for n, t in data["columns"]), tuple(tuple(i) for i in data["indexes"]))
        fine = out.columns and out.indexes and len(out.indexes) <= MAX_INDEXES and all(c.type in _SPARK for c in out.columns)
        if not fine or not all(i and len(set(i)) == len(i) and all(0 <= k < len(out.columns) for k in i) for i in out.indexes):
            raise CorruptStore("corrupted schema")
    except (KeyError, TypeError, ValueError) as e:
        raise CorruptStore("corrupted schema") from e
    return out


def build_schema(table: str, columns: list[tuple[str, str]], pkey: list[str], indexes: list[list[str]] = ()) -> Schema:
    if not columns:
        raise AnalysisError("expect at least one column")
    names = [n for n, _ in columns]
    if len(set(names)) < len(names):
        raise AnalysisError("duplicate column name")
    for names_ in (pkey, *indexes):
        if not names_:
            raise AnalysisError("expect at least one key column")
        if set(names_) - set(names):
            raise AnalysisError("column is not found")
        if len(set(names_)) < len(names_):
            raise AnalysisError("duplicate key column")
    at = {n: i for i, n in enumerate(names)}
    key = tuple(at[n] for n in pkey)
    others = [tuple(at[n] for n in i) for i in indexes]
    full = (key, *(i + tuple(k for k in key if k not in i) for i in others))
    if len(full) > MAX_INDEXES:
        raise AnalysisError(f"more than {MAX_INDEXES} indexes")
    return Schema(table, tuple(Column(n, t) for n, t in columns), full)


def schema_of(stmt: CreateTable) -> Schema:
    return build_schema(stmt.table, stmt.columns, stmt.pkey, stmt.indexes)
