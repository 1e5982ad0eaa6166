"""The engine: a store at a path, statements, transactions, frames in and out."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisError, EngineClosed, InvalidArgument
from .operators.kv import KV
from .operators.transaction import Transaction
from .plans import ast as A
from .result import Result
from .sources.catalog import Schema, build_schema
from .sources.storage import Manifest, Storage


class Engine:
    """Tables and a key-value store below ``root``, a folder that the driver and executors share.

    Every call commits by itself; ``transaction()`` groups calls.  ``fold_after``: how many deltas a
    table gathers before a commit merges the newest of them; an older one is merged too if it is at
    most ``growth`` times as large as what is merged above it, so that a row is written again a
    number of times that grows with the logarithm of the commits only.
    """

    def __init__(self, spark: SparkSession, root: str, fold_after: int = 32, growth: float = 2.0):
        self.spark, self.storage, self.fold_after, self.growth = spark, Storage(spark, root), fold_after, growth
        self.storage.open()
        self.closed = False
        self._cached: dict[str, tuple] = {}
        self.kv = KV(self.transaction)

    @classmethod
    def scratch(cls, spark: SparkSession, tag: str = "engine") -> Engine:
        """An engine on a new folder: in the shared checkpoint folder if the session has one, else,
        where driver and executors are one process, in a temporary folder of this machine."""
        import uuid

        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix=f'stratakeep-{tag}-')}"
        return cls(spark, root)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def transaction(self, version: int | None = None) -> Transaction:
        """A transaction on the newest version, or on an older one that is still kept."""
        if self.closed:
            raise EngineClosed("engine is closed")
        snapshot = self.storage.head() if version is None else self.storage.manifest(version)
        return Transaction(self.storage, snapshot, after=self._tidy)

    @contextmanager
    def _commit(self) -> Iterator[Transaction]:
        with self.transaction() as tx:
            yield tx

    def _tidy(self, tx: Transaction) -> None:
        """After a commit: merge the deltas of tables that have gathered too many."""
        tables = self.storage.head().tables
        for name in set(tx.origins.values()):
            if name in tables and len(tables[name].deltas) > self.fold_after:
                first = self._alike(tables[name].deltas)
                self._maintain(name, lambda s, first=first: self.storage.fold(s, first), lambda s, first=first: len(s.deltas) > first + 1)

    def _alike(self, deltas: tuple[str, ...]) -> int:
        """From which delta on to merge: the last two at least, and those below while they aren't
        much larger than the ones above them together."""
        sizes = [self.storage.files.size(path) for path in deltas]
        first = len(sizes) - 2
        above = sum(sizes[first:])
        while first > 0 and sizes[first - 1] <= self.growth * above:
            first -= 1
            above += sizes[first]
        return first

    # statements

    def sql(self, text: str) -> Result:
        with self._commit() as tx:
            return tx.sql(text)

    def execute(self, stmt: A.Statement) -> Result:
        with self._commit() as tx:
            return tx.execute(stmt)

    # tables

    def tables(self) -> list[str]:
        return sorted(n for n in self.storage.head().tables if not n.startswith("\x00"))

    def schema(self, name: str) -> Schema:
        return self.transaction().schema(name)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.transaction(version).table(name)

    def create_table(self, name: str, columns: list[tuple[str, str]], pkey: list[str], indexes: list[list[str]] = ()) -> None:
        with self._commit() as tx:
            tx.create(build_schema(name, columns, pkey, indexes))

    def register_parquet(self, name: str, path: str, columns: list[tuple[str, str, str]], pkey: list[str], indexes: list[list[str]] = (), verify: bool = False) -> None:
        """Make a Parquet table one of the store's tables without copying it.

        ``columns``: (name, type, Spark SQL expression over the file's columns).  Changes go to
        deltas of the store.  ``verify`` checks that keys are unique and that nothing is null.
        """
        schema = build_schema(name, [(n, t) for n, t, _ in columns], pkey, indexes)
        with self._commit() as tx:
            tx.create(schema, (path, tuple(e for _, _, e in columns)))
            if verify:
                rows = tx.view(name)
                if rows.where(" OR ".join(f"{c} IS NULL" for c in schema.stored)).limit(1).count():
                    raise AnalysisError("a column has nulls")
                if rows.groupBy(*schema.key).count().where("count > 1").limit(1).count():
                    raise AnalysisError("the primary key isn't unique")

    def insert_df(self, name: str, rows: DataFrame) -> int:
        with self._commit() as tx:
            return tx.insert_df(name, rows)

    def upsert_df(self, name: str, rows: DataFrame) -> int:
        with self._commit() as tx:
            return tx.upsert_df(name, rows)

    def update_df(self, name: str, rows: DataFrame) -> int:
        with self._commit() as tx:
            return tx.update_df(name, rows)

    def delete_df(self, name: str, keys: DataFrame) -> int:
        with self._commit() as tx:
            return tx.delete_df(name, keys)

    def select(self, name: str, key: list | tuple) -> tuple | None:
        return self.transaction().select(name, key)

    def seek(self, name: str, key: list | tuple) -> DataFrame:
        return self.transaction().seek(name, key)

    def scan(self, name: str, **bounds) -> DataFrame:
        return self.transaction().scan(name, **bounds)

    # maintenance

    def cached(self, name: str) -> DataFrame:
        """The table's newest version, kept in the executors' memory until a newer one is asked for."""
        state = self.transaction().state(name)
        held = self._cached.get(name)
        if held and held[0] != state:
            held[1].unpersist()
        if not held or held[0] != state:
            self._cached[name] = (state, self.table(name).cache())
        return self._cached[name][1]

    def compact(self, name: str | None = None, partitions: int | None = None, bloom: bool = False) -> list[str]:
        """Rewrite tables as one sorted base; returns those that were rewritten."""
        names = [name] if name is not None else list(self.storage.head().tables)
        return [n for n in names if self._maintain(n, lambda s: self.storage.rewrite(s, partitions, bloom), lambda s: s.deltas or s.external)]

    def fold(self, name: str) -> bool:
        """Merge a table's deltas into one."""
        return self._maintain(name, self.storage.fold, lambda s: len(s.deltas) > 1)

    def _maintain(self, name: str, work, useful) -> bool:
        """Replace a table's files; deltas that commits add meanwhile stay on top."""
        before = self.transaction().state(name)
        if not useful(before):
            return False
        made = work(before)
        while True:
            head = self.storage.head()
            now = head.tables.get(name)
            if now is None or (now.origin, now.base, now.external, now.deltas[: len(before.deltas)]) != (before.origin, before.base, before.external, before.deltas):
                return False  # dropped, or maintained by someone else; vacuum takes the files
            state = replace(made, deltas=(*made.deltas, *now.deltas[len(before.deltas) :]))
            if self.storage.publish(Manifest(head.version + 1, head.tables | {name: state})):
                return True

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete old versions and data that no kept one needs.  Run it while nothing is being
        written: staged data of open transactions isn't known to any version."""
        versions = self.storage.versions()
        return self.storage.vacuum(set(versions[max(0, len(versions) - keep_versions) :]))

    def export(self, path: str) -> None:
        """A copy of this version, catalog and data, that ``Engine(spark, path)`` opens."""
        head = self.storage.head()
        target = Storage(self.spark, path)
        tables = {}
        for name, state in head.tables.items():
            folder = target.new_dir(name)
            self.storage.view(state).write.parquet(folder)
            tables[name] = replace(state, base=folder, external=None, deltas=())
        if not target.publish(Manifest(1, tables)):
            raise AnalysisError("there is a store at the target")
