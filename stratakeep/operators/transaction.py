"""Transactions: a pinned version, staged deltas on top of it, first committer wins.

Everything that changes a table stages a delta and is seen by later reads of the same transaction.
Commit checks that no other commit since the pinned version wrote one of the same keys, then
publishes a manifest with the staged deltas on top of the newest version.  Reads are never
validated: this is snapshot isolation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import AnalysisError, InvalidArgument, TxConflict, TxDone
from ..functions.render import header
from ..plans import analyze
from ..plans import ast as A
from ..plans.compile import Compiler, ordered, wrapping
from ..plans.ordering import Order, plan_order
from ..plans.parser import parse_stmt
from ..result import Result, running
from ..sources.catalog import Schema, schema_of
from ..sources.storage import Manifest, Storage, TableState

_OPS = ("<", "<=", ">", ">=")


class Transaction:
    """Use as a context manager: commits at the end, aborts if an error leaves it."""

    def __init__(self, storage: Storage, snapshot: Manifest | None = None, parent: Transaction | None = None, after: Callable[[Transaction], None] | None = None):
        self.storage, self.parent, self.after = storage, parent, after
        self.snapshot = parent.snapshot if parent else snapshot
        self.tables = dict(parent.tables if parent else snapshot.tables)
        self.wrote: dict[str, list[str]] = {}
        self.origins: dict[str, str] = {}
        self.ddl: set[str] = set()
        self.done = False
        self.version: int | None = None

    # life cycle

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.commit() if kind is None else self.abort()

    def _open(self) -> None:
        if self.done or (self.parent and self.parent.done):
            raise TxDone("TX has already finished")

    def begin(self) -> Transaction:
        """A nested transaction: its commit folds into this one, its abort leaves this one alone.
        Several may be open at a time; none sees what another one does before that commits."""
        self._open()
        return Transaction(self.storage, parent=self)

    def abort(self) -> None:
        self._open()
        self.done = True
        for paths in self.wrote.values():
            for path in paths:
                self.storage.files.delete(path)

    def commit(self) -> None:
        self._open()
        if self.parent:
            self._hand_up(self.parent)
        elif self.wrote or self.ddl:
            self._publish()
        self.done = True
        if self.after and self.version is not None:
            self.after(self)

    def _hand_up(self, parent: Transaction) -> None:
        """Put what this transaction staged on top of the parent's present state, which siblings
        may have changed since this one began; of writes to one key the later commit's stays."""
        for origin, name in self.origins.items():
            gone = name in parent.ddl and name not in parent.tables
            if name not in self.ddl and (gone or name in parent.tables and parent.tables[name].origin != origin):
                raise TxConflict("a sibling transaction has dropped the table")
        for name in self.ddl:
            parent.tables.pop(name, None)
            if name in self.tables:
                parent.tables[name] = self.tables[name]
        for origin, paths in self.wrote.items():
            name = self.origins[origin]
            parent.wrote.setdefault(origin, []).extend(paths)
            if name not in self.ddl:
                below = parent.tables.get(name) or replace(self.tables[name], deltas=())
                parent.tables[name] = replace(below, deltas=(*below.deltas, *paths))
        parent.origins |= self.origins
        parent.ddl |= self.ddl

    def _publish(self) -> None:
        checked = self.snapshot.version
        while True:
            head = self.storage.head()
            for version in range(checked + 1, head.version + 1):
                self._check(self.storage.manifest(version))
            checked = head.version
            manifest = Manifest(head.version + 1, self._merged(head), {k: tuple(v) for k, v in self.wrote.items()}, tuple(sorted(self.ddl)))
            if self.storage.publish(manifest):
                self.version = manifest.version
                return

    def _merged(self, head: Manifest) -> dict[str, TableState]:
        out = dict(head.tables)
        for name in self.ddl:
            out.pop(name, None)
            if name in self.tables:
                out[name] = self.tables[name]
        for origin, paths in self.wrote.items():
            name = self.origins[origin]
            if name in self.ddl:
                continue
            state = out.get(name, self.tables.get(name))
            deltas = (*state.deltas, *paths) if name in out else tuple(paths)
            out[name] = replace(state, deltas=deltas)
        return out

    def _check(self, other: Manifest) -> None:
        """Conflict if the other commit wrote one of our keys, or defined a table that we use."""
        names = set(self.origins.values()) | self.ddl
        if names & set(other.ddl):
            raise TxConflict("TX is conflict with another TX")
        theirs = {o: n for n, t in (self.snapshot.tables | other.tables).items() for o in [t.origin]}
        if self.ddl & {theirs.get(o) for o in other.wrote}:
            raise TxConflict("TX is conflict with another TX")
        for origin in self.wrote.keys() & other.wrote.keys():
            schema = self.tables[self.origins[origin]].schema
            read = lambda paths: self.storage.spark.read.schema(schema.spark(True)).parquet(*paths).select(*schema.key)  # noqa: B023, E731
            if read(self.wrote[origin]).join(read(other.wrote[origin]), schema.key, "left_semi").limit(1).count():
                raise TxConflict("TX is conflict with another TX")

    # tables

    def state(self, name: str) -> TableState:
        self._open()
        if name not in self.tables:
            raise AnalysisError("table is not found")
        return self.tables[name]

    def schema(self, name: str) -> Schema:
        return self.state(name).schema

    def view(self, name: str) -> DataFrame:
        return self.storage.view(self.state(name))

    def table(self, name: str) -> DataFrame:
        """The rows as an ordinary frame under the table's own names; all of Spark applies to it."""
        schema = self.schema(name)
        return self.view(name).select(*[F.col(f"c{i}").alias(c.name) for i, c in enumerate(schema.columns)])

    def create(self, schema: Schema, external: tuple[str, tuple[str, ...]] | None = None) -> None:
        self._open()
        if schema.table in self.tables:
            raise AnalysisError("duplicate table name")
        self.tables[schema.table] = TableState(schema, uuid.uuid4().hex, external=external)
        self.ddl.add(schema.table)

    def drop(self, name: str) -> None:
        state = self.state(name)
        del self.tables[name]
        self.ddl.add(name)
        for path in self.wrote.pop(state.origin, []):
            if not self.parent:
                self.storage.files.delete(path)
        self.origins.pop(state.origin, None)

    # changes of rows; frames have the stored names of the schema

    def stage(self, name: str, rows: DataFrame) -> int:
        """Stage changed rows (one a key, with ``deleted``); returns how many there are."""
        state = self.state(name)
        with running():
            path, n = self.storage.write_delta(state, rows)
        if not n:
            self.storage.files.delete(path)
            return 0
        self.wrote.setdefault(state.origin, []).append(path)
        self.origins[state.origin] = name
        self.tables[name] = replace(state, deltas=(*state.deltas, path))
        return n

    def _incoming(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows by position or name under stored names, one a key (of several the least row)."""
        schema = self.schema(name)
        if len(rows.columns) != len(schema.columns):
            raise AnalysisError("schema mismatch")
        by_name = set(rows.columns) == set(schema.names) and len(set(rows.columns)) == len(rows.columns)
        if by_name:
            rows = rows.select(*[f"`{n}`" for n in schema.names])
        typed = rows.toDF(*schema.stored)
        wanted = {f.name: f.dataType for f in schema.spark()}
        if any(typed.schema[c].dataType != wanted[c] for c in schema.stored):
            raise AnalysisError("schema mismatch")
        if not schema.rest:
            return typed.dropDuplicates()
        first = typed.groupBy(*schema.key).agg(F.min(F.struct(*schema.rest)).alias("row"))
        return first.select(*schema.key, *[F.col(f"row.{c}").alias(c) for c in schema.rest]).select(*schema.stored)

    @contextmanager
    def _near(self, name: str, rows: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        """``rows``, and the table's rows in the range of the first key column that they span: what
        lies outside can't match, and files in key order are skipped by it.

        Where there is a base, ``rows`` are written down once and their range is seen on the way, so
        a frame that gives other rows each time it is run is run once."""
        state = self.state(name)
        view = self.storage.view(state)
        if not state.base and not state.external:
            yield rows, view
            return
        first, seen, path = F.col(state.schema.key[0]), Observation(), self.storage.new_dir(name)
        try:
            with running():
                rows.observe(seen, F.min(first).alias("low"), F.max(first).alias("high")).write.parquet(path)
            low, high = seen.get["low"], seen.get["high"]
            held = self.storage.spark.read.schema(rows.schema).parquet(path)
            yield held, view.where(F.lit(False)) if low is None else view.where(first.between(F.lit(low), F.lit(high)))
        finally:
            self.storage.files.delete(path)

    def insert_df(self, name: str, rows: DataFrame) -> int:
        """Add rows whose key is new; others change nothing.  Returns how many were added."""
        with self._near(name, self._incoming(name, rows)) as (new, near):
            fresh = new.join(near.select(*self.schema(name).key), self.schema(name).key, "left_anti")
            return self.stage(name, fresh.withColumn("deleted", F.lit(False)))

    def upsert_df(self, name: str, rows: DataFrame) -> int:
        """Add or replace rows; returns how many are new or differ from what was there."""
        return self._replace(name, rows, "left")

    def update_df(self, name: str, rows: DataFrame) -> int:
        """Replace rows whose key is there; returns how many differ from what was there."""
        return self._replace(name, rows, "inner")

    def _replace(self, name: str, rows: DataFrame, how: str) -> int:
        schema = self.schema(name)
        with self._near(name, self._incoming(name, rows)) as (new, near):
            old = near.select(*schema.key, F.struct(*schema.rest).alias("old") if schema.rest else F.lit(True).alias("old"))
            joined = new.join(old, schema.key, how)
            differs = ~F.struct(*schema.rest).eqNullSafe(F.col("old")) if schema.rest else F.col("old").isNull()
            return self.stage(name, joined.where(differs).select(*schema.stored, F.lit(False).alias("deleted")))

    def delete_df(self, name: str, keys: DataFrame) -> int:
        """Delete the rows whose key is in ``keys`` (the key's columns, in its order)."""
        schema = self.schema(name)
        if len(keys.columns) != len(schema.key):
            raise AnalysisError("schema mismatch")
        keys = keys.toDF(*schema.key).dropDuplicates()
        with self._near(name, keys) as (keys, near):
            return self.stage(name, _tombstones(schema, near.join(keys, schema.key, "left_semi")))

    def _one(self, name: str, row: list | tuple) -> DataFrame:
        schema = self.schema(name)
        analyze.check_values(row, schema)
        return self.storage.spark.createDataFrame([tuple(row)], schema.spark())

    def insert(self, name: str, row: list | tuple) -> bool:
        new = self._one(name, row)
        if self.select(name, [row[k] for k in self.schema(name).pkey]) is not None:
            return False
        return bool(self.stage(name, new.withColumn("deleted", F.lit(False))))

    def upsert(self, name: str, row: list | tuple) -> bool:
        return self._put(name, row, True)

    def update(self, name: str, row: list | tuple) -> bool:
        return self._put(name, row, False)

    def _put(self, name: str, row: list | tuple, may_add: bool) -> bool:
        new = self._one(name, row)
        old = self.select(name, [row[k] for k in self.schema(name).pkey])
        if (old is None and not may_add) or old == tuple(row):
            return False
        return bool(self.stage(name, new.withColumn("deleted", F.lit(False))))

    def delete(self, name: str, key: list | tuple) -> bool:
        found = self.view(name).where(self._key_is(name, key))
        return bool(self.stage(name, _tombstones(self.schema(name), found)))

    # reads by key

    def _key_is(self, name: str, key: list | tuple):
        schema = self.schema(name)
        if len(key) != len(schema.pkey):
            raise AnalysisError("row does not match the schema")
        out = F.lit(True)
        for k, value in zip(schema.pkey, key, strict=True):
            kind = {int: A.INT, str: A.STR, bytes: A.BYTES}.get(type(value))
            if kind != schema.columns[k].type:
                raise AnalysisError("row does not match the schema")
            out = out & (F.col(f"c{k}") == F.lit(value))
        return out

    def select(self, name: str, key: list | tuple) -> tuple | None:
        """The row of a primary key."""
        found = self.view(name).where(self._key_is(name, key)).limit(1).collect()
        return tuple(bytes(v) if isinstance(v, bytearray) else v for v in found[0]) if found else None

    def seek(self, name: str, key: list | tuple) -> DataFrame:
        """Rows from a primary key on, to the end of the table."""
        return self.scan(name, lower=(">=", list(key)))

    def scan(self, name: str, lower: tuple[str, list] | None = None, upper: tuple[str, list] | None = None, index: int = 0, descending: bool = False) -> DataFrame:
        """Rows of a range of one of the table's keys, in its order.  A bound is an operator and
        values for the key's leading columns; fewer values bound all keys that begin with them."""
        schema = self.schema(name)
        if not 0 <= index < len(schema.indexes):
            raise InvalidArgument("unknown index")
        rows = self.view(name)
        for bound, ops in ((lower, (">", ">=")), (upper, ("<", "<="))):
            if bound:
                op, values = bound
                own = [schema.columns[k] for k in schema.indexes[index]]
                if op not in ops:
                    raise InvalidArgument("invalid range request")
                if len(values) > len(own):
                    raise InvalidArgument("key prefix is longer than the index")
                if any(A.Lit(v).type != c.type for v, c in zip(values, own, strict=False)):
                    raise InvalidArgument("key prefix type mismatch")
                if values:
                    names, literals = [A.Name(c.name) for c in own[: len(values)]], [A.Lit(v) for v in values]
                    node = A.Binary(op, names[0], literals[0]) if len(values) == 1 else A.Binary(op, A.Tuple(tuple(names)), A.Tuple(tuple(literals)))
                    rows = rows.where(Compiler(schema).condition(node))
        rows = ordered(rows, schema, index, descending)
        return rows.select(*[F.col(f"c{i}").alias(c.name) for i, c in enumerate(schema.columns)])

    # the dialect

    def sql(self, text: str) -> Result:
        return self.execute(parse_stmt(text))

    def execute(self, stmt: A.Statement) -> Result:
        self._open()
        if isinstance(stmt, A.Select):
            return self._select(stmt)
        if isinstance(stmt, A.CreateTable):
            self.create(schema_of(stmt))
            return Result()
        if isinstance(stmt, A.DropTable):
            self.drop(stmt.table)
            return Result()
        if isinstance(stmt, A.Insert):
            return Result(rows_affected=int(self.insert(stmt.table, stmt.values)))
        if isinstance(stmt, A.Update):
            return Result(rows_affected=self._update(stmt))
        if isinstance(stmt, A.Delete):
            return Result(rows_affected=self._delete(stmt))
        raise AnalysisError("unsupported statement")

    def _matching(self, table: str, where: A.Expr | None) -> tuple[DataFrame, Schema, Compiler, Order]:
        schema = self.schema(table)
        analyze.check_where(where, schema)
        order, compiler, rows = plan_order(schema, where), Compiler(schema), self.view(table)
        condition = compiler.filter(order)
        return (rows if condition is None else rows.where(condition)), schema, compiler, order

    def _select(self, stmt: A.Select) -> Result:
        with wrapping(self.storage.spark):
            schema = self.schema(stmt.table)
            items = analyze.expand(stmt.items, schema)
            for item in items:
                analyze.check_depth(item)
            columns = [(header(item), analyze.type_of(item, schema)) for item in items]
            found, _, compiler, order = self._matching(stmt.table, stmt.where)
            rows = ordered(found, schema, order.index, order.descending)
            if stmt.offset:
                rows = rows.offset(stmt.offset)
            if stmt.limit is not None:
                rows = found = rows.limit(stmt.limit)
            # items are evaluated for the rows that are returned, and for no others
            values = [compiler.value(item).alias(name) for item, (name, _) in zip(items, columns, strict=True)]
            return Result(columns, found.select(*values), ordered=rows.select(*values))

    def _update(self, stmt: A.Update) -> int:
        with wrapping(self.storage.spark):
            schema = self.schema(stmt.table)
            new = analyze.check_assignments(stmt.assignments, schema)
            rows, _, compiler, _ = self._matching(stmt.table, stmt.where)
            # every right side sees the row as it was
            values = {f"n{at}": compiler.value(value) for at, value in new.items()}
            rows = rows.withColumns(values)
            changed = F.lit(False)
            for at in new:
                changed = changed | (F.col(f"n{at}") != F.col(f"c{at}"))
            columns = [F.col(f"n{i}" if i in new else f"c{i}").alias(f"c{i}") for i in range(len(schema.columns))]
            rows = rows.where(changed).select(*columns, F.lit(False).alias("deleted"))
        return self.stage(stmt.table, rows)

    def _delete(self, stmt: A.Delete) -> int:
        with wrapping(self.storage.spark):
            rows, schema, _, _ = self._matching(stmt.table, stmt.where)
            rows = _tombstones(schema, rows)
        return self.stage(stmt.table, rows)


def _tombstones(schema: Schema, rows: DataFrame) -> DataFrame:
    """Deletions of rows: keys only, so nothing else is read or written for them."""
    kinds = {f.name: f.dataType for f in schema.spark()}
    columns = [F.col(c) if c in schema.key else F.lit(None).cast(kinds[c]).alias(c) for c in schema.stored]
    return rows.select(*columns, F.lit(True).alias("deleted"))
