"""An ordered store of byte keys and byte values, on the same versions and transactions as tables.

Keys order bytewise, unsigned.  Keys that begin with ``RESERVED`` belong to the engine: the guarded
calls refuse them and scans skip them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, KeyNotFound, ReservedKey
from ..plans.ast import BYTES
from ..sources.catalog import Column, Schema
from ..sources.storage import TableState
from .transaction import Transaction

TABLE = "\x00kv"
RESERVED = b"\x00stratakeep\x00"
SCHEMA = Schema(TABLE, (Column("key", BYTES), Column("value", BYTES)), ((0,),))
#: There is one key space, so transactions that begin it at the same time write the same table.
ORIGIN = "kv"
UPSERT, INSERT, UPDATE = "upsert", "insert", "update"
RANGE_CAP = 10_000
COMMANDS = "seq long, op string, key binary, value binary, mode string"


def check_key(key: bytes) -> None:
    if not key or key.startswith(RESERVED):
        raise ReservedKey("key is empty or reserved")


class KV:
    """``transaction`` gives the transaction that a call runs in, as a context manager."""

    def __init__(self, transaction):
        self._transaction = transaction

    @contextmanager
    def _in(self) -> Iterator[Transaction]:
        with self._transaction() as tx:
            tx.tables.setdefault(TABLE, TableState(SCHEMA, ORIGIN))
            yield tx

    # points

    def get(self, key: bytes) -> bytes | None:
        with self._in() as tx:
            row = tx.select(TABLE, [key])
        return row[1] if row else None

    def need(self, key: bytes) -> bytes:
        """The value of a key that must be there and mustn't be reserved."""
        check_key(key)
        value = self.get(key)
        if value is None:
            raise KeyNotFound("key is not found")
        return value

    def get_many(self, keys: DataFrame) -> DataFrame:
        """(key, value) of those keys (first column of ``keys``) that are there: one join."""
        with self._in() as tx:
            wanted = keys.toDF("c0").distinct()
            return _named(tx.view(TABLE).join(wanted, "c0"))

    def put(self, key: bytes, value: bytes, mode: str = UPSERT) -> bool:
        """Write one pair; was anything changed?"""
        with self._in() as tx:
            if mode == INSERT:
                return tx.insert(TABLE, [key, value])
            if mode == UPDATE:
                return tx.update(TABLE, [key, value])
            if mode == UPSERT:
                return tx.upsert(TABLE, [key, value])
            raise InvalidArgument(f"invalid update mode: {mode}")

    def put_checked(self, key: bytes, value: bytes, mode: str = UPSERT) -> bool:
        check_key(key)
        return self.put(key, value, mode)

    def delete(self, key: bytes) -> bool:
        with self._in() as tx:
            return tx.delete(TABLE, [key])

    def delete_checked(self, key: bytes) -> bool:
        check_key(key)
        return self.delete(key)

    # ranges

    def items(self) -> DataFrame:
        """Every live pair of this version, reserved keys too, in order."""
        return self.range(b"", None)

    def seek(self, key: bytes) -> DataFrame:
        """Pairs from ``key`` on."""
        return self.range(key, None)

    def last(self) -> DataFrame:
        """Pairs from the greatest key down."""
        return self.range(None, b"", descending=True)

    def range(self, start: bytes | None, stop: bytes | None, descending: bool = False) -> DataFrame:
        """Pairs between two keys, both included; None is open.  Descending runs from start down."""
        with self._in() as tx:
            rows = tx.view(TABLE)
        low, high = (stop, start) if descending else (start, stop)
        if low:
            rows = rows.where(F.col("c0") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col("c0") <= F.lit(high))
        return _named(rows.orderBy(F.col("c0").desc() if descending else F.col("c0").asc()))

    def scan(self, start: bytes = b"", stop: bytes = b"", descending: bool = False, limit: int = 0, keys_only: bool = False, cap: int = RANGE_CAP) -> DataFrame:
        """A range for clients: empty bounds are open, reserved keys are skipped, and at most
        ``limit`` pairs come, or ``cap`` where the limit is 0 or larger."""
        rows = self.range(start or None, stop or None, descending)
        # with an escape-free comparison, so that it can be pushed to the files
        after = RESERVED[:-1] + bytes([RESERVED[-1] + 1])
        rows = rows.where((F.col("key") < F.lit(RESERVED)) | (F.col("key") >= F.lit(after)))
        rows = rows.limit(min(limit or cap, cap))
        return rows.select("key") if keys_only else rows

    # many at once

    def upsert_df(self, pairs: DataFrame) -> int:
        with self._in() as tx:
            return tx.upsert_df(TABLE, pairs.toDF("key", "value"))

    def apply(self, commands: Iterable[tuple]) -> bool:
        """Run (op, key, value, mode) in order as one commit; did anything change?

        ``op`` is "put" or "del".  Later commands see what earlier ones did.
        """
        rows = []
        for i, (op, key, value, mode) in enumerate(commands):
            if op not in ("put", "del"):
                raise InvalidArgument(f"batch mutation {i}: unknown op {op!r}")
            if op == "put" and mode not in (UPSERT, INSERT, UPDATE):
                raise InvalidArgument(f"batch mutation {i}: invalid update mode: {mode}")
            rows.append((i, op, key, value if op == "put" else None, mode if op == "put" else None))
        if not rows:
            return False
        with self._in() as tx:
            changed = self.apply_df(tx.storage.spark.createDataFrame(rows, COMMANDS))
        return changed > 0

    def apply_df(self, commands: DataFrame) -> int:
        """The same for a frame (seq, op, key, value, mode); returns how many commands took effect.

        Whether a key exists before a command follows from the last put-or-insert or delete before
        it, and its value from the last effective put, so two running windows over a key's commands
        settle everything; no key's commands are gathered in one row.
        """
        with self._in() as tx:
            old = tx.view(TABLE).select(F.col("c0").alias("key"), F.col("c1").alias("old"), F.lit(True).alias("was"))
            rows = commands.join(old, "key", "left").withColumn("was", F.coalesce("was", F.lit(False)))
            before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
            sets = F.when(F.col("op") == "del", False).when(F.col("mode") != UPDATE, True)
            rows = rows.withColumn("there", F.coalesce(F.last(sets, ignorenulls=True).over(before), F.col("was")))
            is_put = (F.col("op") == "put") & F.when(F.col("mode") == INSERT, ~F.col("there")).when(F.col("mode") == UPDATE, F.col("there")).otherwise(True)
            rows = rows.withColumn("puts", is_put)
            written = F.last(F.when(F.col("puts"), F.struct("value")), ignorenulls=True).over(before)
            rows = rows.withColumn("now", F.when(F.col("there"), F.coalesce(written["value"], F.col("old"))))
            took = F.when(F.col("op") == "del", F.col("there")).otherwise(F.col("puts") & ~F.col("now").eqNullSafe(F.col("value")))
            rows = rows.withColumn("took", took)
            after = F.when(F.col("op") == "del", F.lit(None).cast("binary")).when(F.col("puts"), F.col("value")).otherwise(F.col("now"))
            final = rows.groupBy("key").agg(F.max_by(after, "seq").alias("value"), F.first("old").alias("old"), F.count_if("took").alias("took"))
            # commands that cancel out stage their key all the same: it was written
            final = final.where("took > 0").select(F.col("key").alias("c0"), F.coalesce("value", F.lit(b"")).alias("c1"), F.col("value").isNull().alias("deleted"), "took")
            seen = Observation()
            tx.stage(TABLE, final.observe(seen, F.sum("took").alias("took")).drop("took"))
            return int(seen.get["took"] or 0)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("c0").alias("key"), F.col("c1").alias("value"))
