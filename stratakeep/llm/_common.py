"""Helpers shared by the training-data operators: shared storage, code shipping, nulls."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    It is ``spark.checkpoint.dir`` where the session has one.  Only where it is unset and driver and
    executors are one process (a local test) a temporary folder of this machine serves.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="stratakeep-"))
        atexit.register(_remove_local)
    return f"file://{_LOCAL_ROOT[0]}"


def _remove_local() -> None:
    import shutil

    for path in _LOCAL_ROOT:
        shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/stratakeep-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratakeep_path = path
    return out


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete what ``materialise`` wrote inside when the block ends, but for frames handed to the
    function that it yields; those belong to the block around this one."""
    _SCOPES.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stratakeep_path)
        return df

    try:
        yield keep
    finally:
        paths = _SCOPES.pop()
        for scope in _SCOPES[-1:]:
            scope += kept
        for path in paths:
            if path not in kept:
                delete_path(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``materialise`` that nothing reads any more."""
    path = getattr(df, "_stratakeep_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that a Python worker gets at a time; each can carry a whole text or two.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have it installed (once per context),
    and batches for Python workers short, unless the session has set their length itself."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if getattr(context, "_stratakeep_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="stratakeep-code-")
    archive = os.path.join(folder, "stratakeep_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._stratakeep_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for a wide exchange; follows the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_fs(path: str):
    """``(filesystem, path)`` for Python code on executors; any scheme that pyarrow knows."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def released(run):
    """``run`` for mapInArrow, giving memory back when it ends: Python workers live on and serve
    other tasks, and an executor has to hold all of them."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def empty_if_null(column: str):
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of one key that meet in one task of ``spread_join``.
ROWS_OF_A_KEY = 1000
#: Keys with more rows than that, up to which they are sent to every executor.
BROADCAST_KEYS = 200_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``keys`` where ``left`` may have any number of rows of one key.

    A key with more than ``ROWS_OF_A_KEY`` rows is dealt out by a hash of column ``by``, and its rows
    on the right are repeated once for each share, so no task gets more than a share.  ``counts``
    has the number n of rows of each key on the left, where it is known.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > ROWS_OF_A_KEY)
    hot = materialise(hot.select(*keys, F.ceil(F.col("n") / ROWS_OF_A_KEY).alias("ways")), "hot-keys")
    shown = F.broadcast(hot) if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hot
    ways = F.coalesce("ways", F.lit(1))
    dealt = left.join(shown, keys, "left").withColumn("share", F.pmod(F.xxhash64(by), ways)).drop("ways")
    copies = right.join(shown, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop("ways")
    return dealt.join(copies, [*keys, "share"]).drop("share")
