"""Repeated byte strings by a distributed difference-cover sort of suffixes.

1. Sampled suffixes, those that start at 1 or 2 modulo 3 of their document, are named by the rank
   of their first three words of seven bytes in one distributed sort.
2. Names are sorted in triples in turn: the names of i, i + d and i + 2d, with d the bytes that a
   name spans so far, are ranked the same way and give names of 3d bytes; so on until they span
   most of the string length, then once more with an overlap that makes it exact.  A sampled suffix
   whose name is its own alone repeats nowhere; it is left out from there on, with those that would
   span it, and so are suffixes that end before a name does.
3. The other suffixes are merged in: any two suffixes have an offset of at most two bytes at which
   both are sampled, so every pair meets in one of three orders, each sorted by the bytes before
   that offset, the name at it and the bytes that the name doesn't span.
4. Neighbours in an order are compared: one whose whole key equals the one before it also starts
   earlier.

Everything that is sorted is a narrow row a position, which is what makes the method expensive: see
the README for what the check tool measured.  ``bytespans`` finds the same strings from far fewer
rows; tests hold the two against each other.

Edge cases are those of ``bytespans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _grams as G
from ._common import materialise, released, ship, width

_SAMPLES = "doc long, at int, a long, b long, c long"
_ORDERS = "way int, a long, b long, doc long, at int"


def _rank(rows: DataFrame) -> DataFrame:
    """(doc, at, name, alone): the rank of (a, b, c) among all different ones, from 1, and whether
    no other row has it.  One range exchange; only a row a partition goes to the driver's plan."""
    keys = ["a", "b", "c"]
    spark = rows.sparkSession
    # ties are dealt by position too, so a triple that many positions share fills several partitions
    dealt = rows.repartitionByRange(width(spark), *keys, "doc", "at").sortWithinPartitions(*keys, "doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, name = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            doc, at, a, b, c, pid = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            part = int(pid[0]) if part is None else part
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            new[0] = last != (a[0], b[0], c[0])
            local = name + np.cumsum(new)
            name, last = int(local[-1]), (a[-1], b[-1], c[-1])
            edge = np.zeros(len(a), bool)
            edge[0], edge[-1] = True, True  # a batch's ends; the partition's are among them
            shown = lambda x: pa.array(x, mask=~edge)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(np.full(len(a), part, np.int32)), pa.array(local), shown(a), shown(b), shown(c)], names=["doc", "at", "part", "local", "a", "b", "c"])

    local = dealt.withColumn("pid", F.spark_partition_id()).mapInArrow(released(run), "doc long, at int, part int, local long, a long, b long, c long")
    local = materialise(local, "named")
    ends = local.where("a IS NOT NULL").groupBy("part").agg(F.max("local").alias("n"), F.min_by(F.struct(*keys), "local").alias("first"), F.max_by(F.struct(*keys), "local").alias("last"))
    before = Window.orderBy("part")  # one row a partition
    ends = ends.withColumn("joined", F.coalesce((F.lag("last").over(before) == F.col("first")).cast("long"), F.lit(0)))
    ends = ends.withColumn("offset", F.sum(F.col("n") - F.col("joined")).over(before) - F.col("n"))
    named = local.join(F.broadcast(ends.select("part", "offset")), "part").select("doc", "at", (F.col("local") + F.col("offset")).alias("name"))
    named = materialise(named, "names")
    alone = named.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name", F.lit(True).alias("alone"))
    return named.join(alone, "name", "left").select("doc", "at", "name", F.coalesce("alone", F.lit(False)).alias("alone"))


def _by_document(named: DataFrame) -> DataFrame:
    """Names of each document in lists that its own length bounds."""
    return named.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "name", "alone"))).alias("names"))


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    offsets, flat = column.offsets.to_numpy(), column.flatten()
    parts = [flat.field(f).to_numpy(zero_copy_only=False) for f in ("at", "name", "alone")]
    for i, j in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
        yield tuple(p[i:j] for p in parts)


def _first(docs: DataFrame, word: int) -> DataFrame:
    """Triples of words of ``word`` bytes, straight from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = G.utf8(batch.column(1))
            for i, j in G.slices(offsets):
                own, end = data[offsets[i] : offsets[j]].astype(np.int64), offsets[i : j + 1] - offsets[i]
                packed = np.zeros(max(0, len(own) - word + 1), np.int64)
                for k in range(word):
                    packed = packed * 256 + own[k : k + len(packed)]
                pos = G.valid_starts(end, 3 * word)
                doc = np.searchsorted(end, pos, "right") - 1
                sampled = (pos - end[doc]) % 3 > 0
                pos, doc = pos[sampled], doc[sampled]
                words = [pa.array(packed[pos + k * word]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array((pos - end[doc]).astype(np.int32)), *words], names=["doc", "at", "a", "b", "c"])

    return docs.select("doc", "text").mapInArrow(released(run), _SAMPLES)


def _triples(named: DataFrame, step: int, second: int = 0) -> DataFrame:
    """Names at i, i + step and i + 2 step (or only at i and i + ``second``) of suffixes none of
    whose names is theirs alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, (at, name, alone) in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
                every = np.zeros((int(at[-1]) if len(at) else 0) + 1 + 2 * max(step, second), np.int64)
                every[at] = name
                # without a name there is no string of this length there, or none that repeats
                every[at[alone]] = 0
                keep = at[(every[at] > 0) & (every[at + (second or step)] > 0) & ((every[at + 2 * step] > 0) | (second > 0))]
                cols = [every[keep], every[keep + (second or step)], np.zeros(len(keep), np.int64) if second else every[keep + 2 * step]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), doc, np.int64)), pa.array(keep.astype(np.int32)), *(pa.array(c) for c in cols)], names=["doc", "at", "a", "b", "c"])

    return _by_document(named).mapInArrow(released(run), _SAMPLES)


def _orders(docs: DataFrame, named: DataFrame, span: int, length: int) -> DataFrame:
    """Every suffix that can repeat, in the orders in which it meets others: order ``way`` compares
    the first ``way`` bytes, then names, then the bytes from way + span to length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = G.utf8(batch.column(1))
            for k, (doc, (at, name, alone)) in enumerate(zip(batch.column(0).to_pylist(), _lists(batch.column(2)), strict=True)):
                own = data[offsets[k] : offsets[k + 1]].astype(np.int64)
                start = np.arange(max(0, len(own) - length + 1))
                every = np.zeros(len(own) + 3, np.int64)
                every[at[~alone]] = name[~alone]
                for way, classes in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
                    i = start[np.isin(start % 3, classes)]
                    i = i[every[i + way] > 0]
                    rest = np.zeros(len(i), np.int64)
                    for j in [*range(way), *range(way + span, length)]:
                        rest = rest * 256 + own[i + j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), way, np.int32)), pa.array(every[i + way]), pa.array(rest), pa.array(np.full(len(i), doc, np.int64)), pa.array(i.astype(np.int32))], names=["way", "a", "b", "doc", "at"])

    lists = _by_document(named)
    return docs.join(lists, "doc").select("doc", "text", "names").mapInArrow(released(run), _ORDERS)


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(doc, at) of every ``length``-byte string that also starts earlier.  ``docs``: doc (unique,
    not null), text."""
    if length < 12:
        raise ValueError("strings of fewer than 12 bytes aren't served")
    ship(docs.sparkSession)
    word = min(7, (length - 2) // 3)
    named, span = materialise(_rank(_first(docs, word)), "names"), 3 * word
    while 3 * span <= length - 2:
        named, span = materialise(_rank(_triples(named, span)), "names"), 3 * span
    more = (length - 2 - span) // 3 * 3  # an overlap that keeps the class modulo 3
    while more > 0:
        step = min(more, span)
        named, span, more = materialise(_rank(_triples(named, span, step)), "names"), span + step, more - step
    if length - span > 7:
        raise ValueError("internal: the rest of a key must fit 64 bits")
    rows = _orders(docs, named, span, length)
    dealt = rows.repartitionByRange(width(rows.sparkSession), "way", "a", "b").sortWithinPartitions("way", "a", "b", "doc", "at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            way, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            same = np.zeros(len(a), bool)
            same[1:] = (way[1:] == way[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            same[0] = last == (way[0], a[0], b[0])
            last = (way[-1], a[-1], b[-1])
            take = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([batch.column(3).take(take), batch.column(4).take(take)], names=["doc", "at"])

    return dealt.mapInArrow(released(compare), "doc long, at int").distinct()
