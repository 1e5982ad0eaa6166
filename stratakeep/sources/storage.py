"""Versioned tables over Parquet in any file system that Spark reaches.

A version of the store is one small JSON manifest, created exclusively and checksummed: publishing
it is the commit.  A table is a base (files sorted by the primary key, or an external Parquet table
seen through expressions) and a list of deltas; a delta has one row for each key that a commit
wrote, with a flag for deletions.  Files are never changed, so a reader pins a version by knowing it.

    root/manifest/00000000000000000007.json
    root/data/<table>-<random>/part-*.parquet
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptStore
from .catalog import Schema, from_json

_DIGITS = 20


class Files:
    """The few file operations a commit needs, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, path: str):
        return self._path(path if "://" in path or path.startswith(("/", "file:")) else f"{self.root}/{path}")

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def publish(self, path: str, data: bytes) -> bool:
        """Create ``path`` with all of its content at once; False if it is there already."""
        self.fs.mkdirs(self.at(path).getParent())
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        self.write(draft, data)
        try:
            local = self.fs.getUri().getScheme() == "file"
            if local:  # a link fails if the name is taken; a rename there would replace it
                import os

                os.link(self.at(draft).toUri().getPath(), self.at(path).toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
                context.rename(self.at(draft), self.at(path), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception:
            if self.fs.exists(self.at(path)):
                return False
            raise
        finally:
            self.fs.delete(self.at(draft), False)

    def names(self, path: str) -> list[str]:
        if not self.fs.exists(self.at(path)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def size(self, path: str) -> int:
        """Bytes below a folder."""
        return self.fs.getContentSummary(self.at(path)).getLength()


@dataclass(frozen=True)
class TableState:
    """What a table is in one version.  ``origin`` tells tables of one name apart."""

    schema: Schema
    origin: str
    base: str | None = None
    external: tuple[str, tuple[str, ...]] | None = None
    deltas: tuple[str, ...] = ()

    def to_json(self) -> dict:
        external = [self.external[0], list(self.external[1])] if self.external else None
        return {"schema": self.schema.to_json(), "origin": self.origin, "base": self.base, "external": external, "deltas": list(self.deltas)}

    @classmethod
    def from_json(cls, data: dict) -> TableState:
        external = (data["external"][0], tuple(data["external"][1])) if data["external"] else None
        return cls(from_json(data["schema"]), data["origin"], data["base"], external, tuple(data["deltas"]))


@dataclass(frozen=True)
class Manifest:
    """``wrote``: deltas that the commit added, by origin; ``ddl``: names it created or dropped."""

    version: int
    tables: dict[str, TableState] = field(default_factory=dict)
    wrote: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ddl: tuple[str, ...] = ()

    def to_bytes(self) -> bytes:
        body = {"version": self.version, "tables": {n: t.to_json() for n, t in self.tables.items()}, "wrote": {k: list(v) for k, v in self.wrote.items()}, "ddl": list(self.ddl)}
        text = json.dumps(body, sort_keys=True)
        return json.dumps({"checksum": zlib.crc32(text.encode()), "body": text}).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Manifest:
        try:
            outer = json.loads(data)
            if zlib.crc32(outer["body"].encode()) != outer["checksum"]:
                raise CorruptStore("checksum of a manifest differs")
            body = json.loads(outer["body"])
            tables = {n: TableState.from_json(t) for n, t in body["tables"].items()}
            return cls(body["version"], tables, {k: tuple(v) for k, v in body["wrote"].items()}, tuple(body["ddl"]))
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptStore("a manifest can't be read") from e


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._known: dict[int, Manifest] = {}

    def _name(self, version: int) -> str:
        return f"manifest/{version:0{_DIGITS}d}.json"

    def versions(self) -> list[int]:
        return [int(n[:_DIGITS]) for n in self.files.names("manifest") if n.endswith(".json")]

    def open(self) -> None:
        """Begin an empty store where there is none; refuse data that no manifest tells of."""
        if not self.versions():
            if self.files.names("data"):
                raise CorruptStore("there is data but no manifest")
            self.publish(Manifest(1))

    def head(self) -> Manifest:
        versions = self.versions()
        if not versions:
            raise CorruptStore("there is no manifest")
        return self.manifest(versions[-1])

    def manifest(self, version: int) -> Manifest:
        if version not in self._known:
            self._known[version] = Manifest.from_bytes(self.files.read(self._name(version)))
        return self._known[version]

    def publish(self, manifest: Manifest) -> bool:
        return self.files.publish(self._name(manifest.version), manifest.to_bytes())

    def new_dir(self, table: str) -> str:
        safe = "".join(c if c.isalnum() else "_" for c in table)[:40]
        return f"{self.files.root}/data/{safe}-{uuid.uuid4().hex}"

    def write_delta(self, state: TableState, rows: DataFrame) -> tuple[str, int]:
        """Stage rows (stored columns and ``deleted``); the folder and the number of rows, which
        are counted as they are written."""
        path, seen = self.new_dir(state.schema.table), Observation()
        rows.select(*state.schema.stored, "deleted").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, seen.get["n"]

    def base(self, state: TableState) -> DataFrame:
        schema = state.schema
        if state.external:
            path, exprs = state.external
            return self.spark.read.parquet(path).selectExpr(*[f"{e} AS c{i}" for i, e in enumerate(exprs)])
        if state.base:
            return self.spark.read.schema(schema.spark()).parquet(state.base)
        return self.spark.createDataFrame([], schema.spark())

    def newest(self, state: TableState) -> DataFrame:
        """The last word of the deltas on each key they mention."""
        schema = state.schema
        read = lambda path: self.spark.read.schema(schema.spark(True)).parquet(path)
        if len(state.deltas) == 1:
            return read(state.deltas[0])
        parts = [read(path).withColumn("turn", F.lit(i)) for i, path in enumerate(state.deltas)]
        while len(parts) > 1:
            parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        rest = [*schema.rest, "deleted"]
        last = parts[0].groupBy(*schema.key).agg(F.max_by(F.struct(*rest), "turn").alias("last"))
        return last.select(*schema.key, *[F.col(f"last.{c}").alias(c) for c in rest]).select(*schema.stored, "deleted")

    def view(self, state: TableState) -> DataFrame:
        """Live rows under their stored names, in no particular order."""
        base = self.base(state)
        if not state.deltas:
            return base
        newest = self.newest(state)
        live = newest.where(~F.col("deleted")).select(*state.schema.stored)
        if not state.base and not state.external:
            return live
        return base.join(newest.select(*state.schema.key), state.schema.key, "left_anti").select(*state.schema.stored).unionByName(live)

    def rewrite(self, state: TableState, partitions: int | None = None, bloom: bool = False) -> TableState:
        """The table as one base in the order of its primary key, so that key ranges prune files.
        ``bloom`` adds filters on key columns, which spare point reads most row groups."""
        rows, keys = self.view(state), [F.col(c) for c in state.schema.key]
        dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
        path = self.new_dir(state.schema.table)
        writer = dealt.sortWithinPartitions(*keys).write
        for column in state.schema.key if bloom else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
        return replace(state, base=path, external=None, deltas=())

    def fold(self, state: TableState, first: int = 0) -> TableState:
        """Deltas from the ``first`` on merged to one, which is cheap where what lies below is large."""
        path, _ = self.write_delta(state, self.newest(replace(state, deltas=state.deltas[first:])))
        return replace(state, deltas=(*state.deltas[:first], path))

    def vacuum(self, keep: set[int]) -> int:
        """Delete manifests that aren't kept and data that no kept one names; folders deleted."""
        versions = self.versions()
        keep = (keep | set(versions[-1:])) & set(versions)
        used = set()
        for version in keep:
            for state in self.manifest(version).tables.values():
                used |= {p.rsplit("/", 1)[-1] for p in (*state.deltas, *([state.base] if state.base else []))}
        for version in set(versions) - keep:
            self.files.delete(self._name(version))
        gone = [name for name in self.files.names("data") if name not in used]
        for name in gone:
            self.files.delete(f"data/{name}")
        return len(gone)
