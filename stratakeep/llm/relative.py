"""Relative Lempel-Ziv parsing of word stretches against indexed reference blocks.

A reference block holds stretches of documents.  Its index is the suffix array of their words, whose
numbers are exact (equal for equal words only), with the common prefixes of neighbours.  A stretch is
factored greedily: the longest prefix of what is left that also starts elsewhere in the block is the
next factor, a word that starts nowhere else is a factor of its own.  Every window inside a factor
of at least the window's length repeats.  A window that crosses the boundary of two factors may
repeat too, as greedy factors end where the longest match from *their* start ends; so windows across
boundaries are looked up in the index one by one.

Which stretches meet in a block: all windows of a stretch hold one anchor (``repeats``), and windows
that are equal hold equal anchors, so stretches are dealt out by anchor and a stretch is factored
against every block that can hold a match.  An anchor with more than ``STRETCHES`` different
stretches is split: its windows fall into ranges of offsets from the anchor, all windows of one
range share a core of words around it, and each range goes by its core.  Ranges are halved until
the groups are small or a range is one window; windows of that last kind are counted by the
SHA-256 of their words.  So no task holds an unbounded group, and each stretch goes
on in at most as many rows as it has windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._common import BROADCAST_KEYS, materialise, released, spread_join, width

#: Stretches of one group that a reference block takes whole, and stretches of a block.
STRETCHES = 256
BLOCK = 4096
_ROWS = "key long, wide int, doc long, first long, more int, anchor int, told boolean, words binary"
_RUNS = "doc long, first long, more int"


@dataclass(frozen=True)
class Factor:
    """``length`` words from ``start`` of a stretch, and one place where they stand elsewhere (a
    stretch of the block and an offset; -1 where the word stands nowhere else)."""

    start: int
    length: int
    stretch: int
    offset: int


class ReferenceBlock:
    """Stretches of words with the index that they are factored against."""

    def __init__(self, names: np.ndarray, bounds: np.ndarray):
        """``names`` are the words' numbers, ``bounds`` the stretches' first words and the end."""
        self.bounds = bounds
        count = len(bounds) - 1
        size = np.diff(bounds)
        self.start = bounds[:-1] + np.arange(count)  # an end mark follows each stretch
        self.end = self.start + size
        marked = np.full(len(names) + count, -1, np.int64)
        at = np.ones(len(marked), bool)
        at[self.end] = False
        marked[at] = names
        top = int(names.max()) + 1 if len(names) else 0
        marked[self.end] = top + np.arange(count)  # no two end marks are equal
        self._index(marked, int(size.max()) + 1 if count else 1)

    def _index(self, marked: np.ndarray, longest: int) -> None:
        """Suffix array and common prefixes from ranks of runs of 1, 2, 4, ... words."""
        n = len(marked)
        ranks = [np.unique(marked, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(ranks) - 1) < longest:
            step = 1 << (len(ranks) - 1)
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = ranks[-1][step:] + 1
            ranks.append(np.unique((ranks[-1] << 32) | after, return_inverse=True)[1].astype(np.int64))
        order = np.argsort(ranks[-1], kind="stable")
        common = np.zeros(max(0, n - 1), np.int64)  # of neighbours in the order
        left, right = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(left, right) + (1 << k) <= n
            same = inside & (ranks[k][np.minimum(left, n - 1)] == ranks[k][np.minimum(right, n - 1)])
            common += same * (1 << k)
            left, right = left + same * (1 << k), right + same * (1 << k)
        before, after = np.append(0, common), np.append(common, 0)
        self.match = np.zeros(n, np.int64)
        self.match[order] = np.maximum(before, after)[:n]
        self.source = np.full(n, -1, np.int64)
        self.source[order] = np.where(before >= after, np.append(-1, order[:-1]), np.append(order[1:], -1))[:n]

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """Greedy factors of all stretches, as starts and lengths in the marked text; all stretches
        take their next factor at once."""
        at, end = self.start[self.start < self.end], self.end[self.start < self.end]
        starts, lengths = [], []
        while len(at):
            step = np.maximum(self.match[at], 1)
            starts.append(at)
            lengths.append(step)
            at = at + step
            live = at < end
            at, end = at[live], end[live]
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(lengths)) if starts else (none, none)

    def factors(self, stretch: int) -> list[Factor]:
        """The factors of one stretch in order."""
        out, at = [], int(self.start[stretch])
        while at < self.end[stretch]:
            length = max(1, int(self.match[at]))
            source = int(self.source[at]) if self.match[at] else -1
            home = int(np.searchsorted(self.start, source, "right")) - 1 if source >= 0 else -1
            out.append(Factor(at - int(self.start[stretch]), length, home, source - int(self.start[home]) if source >= 0 else -1))
            at += length
        return out

    def repeated(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that start elsewhere too: their stretches and offsets, ascending."""
        starts, lengths = self.parse()
        n = len(self.match)
        edge = np.zeros(n + 1, np.int64)
        long = lengths >= window
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, starts[long] + lengths[long] - window + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        # windows that no long factor holds but that cross the end of a factor are looked up
        size = self.end - self.start - window + 1
        every = G.valid_starts(np.concatenate((self.start, [n])), window + 1) if n else np.zeros(0, np.int64)
        stretch = np.searchsorted(self.start, every, "right") - 1
        every, stretch = every[every - self.start[stretch] < size[stretch]], stretch[every - self.start[stretch] < size[stretch]]
        found = inside[every]
        begins = np.zeros(n + 1, np.int64)
        begins[starts] = 1
        begun = np.cumsum(begins)
        crosses = ~found & (begun[every + window - 1] > begun[every])
        found[crosses] = self.match[every[crosses]] >= window
        return stretch[found], (every - self.start[stretch])[found]


def block_of(texts: list[str]) -> ReferenceBlock:
    """A reference block of the words of ``texts``."""
    words = G.Words(*G.utf8(pa.array(texts, pa.string())))
    return ReferenceBlock(words.names(), words.doc_start)


def _joined(words: G.Words, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The words [begin, stop) of each row as bytes, a space after each word."""
    count = stop - begin
    word = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    size = words.end[word] - words.start[word] + 1
    ends = np.cumsum(size)
    inside = np.repeat(words.start[word] - (ends - size), size) + np.arange(int(size.sum()))
    plain = np.append(words.data, np.uint8(32))[inside]
    plain[ends - 1] = 32
    at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain)]).cast(pa.binary())


def _rows(key, wide, doc, first, more, anchor, told, words) -> pa.RecordBatch:
    columns = [pa.array(G.signed(key)), pa.array(np.broadcast_to(np.int32(wide), len(key))), pa.array(doc), pa.array(first.astype(np.int64))]
    columns += [pa.array(more.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(told), words]
    return pa.RecordBatch.from_arrays(columns, names=["key", "wide", "doc", "first", "more", "anchor", "told", "words"])


def stretches(docs: DataFrame, checks: DataFrame, window: int, gram: int, unpack) -> DataFrame:
    """A row for each stretch in ``checks`` (doc, at, n): its anchor as key and its words."""
    listed = checks.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = G.utf8(batch.column(1))
            flat = batch.column(2).flatten()
            at_all, n_all = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "n"))
            size = np.diff(batch.column(2).offsets.to_numpy())
            bound = np.concatenate(([0], np.cumsum(size)))
            for i, j in G.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                words = G.Words(part, offsets[i : j + 1] - offsets[i])
                doc = np.repeat(np.arange(j - i), size[i:j])
                first, more, anchor = unpack(at_all[bound[i] : bound[j]])
                good = first + more + window <= np.diff(words.doc_start)[doc]
                doc, first, more, anchor, n = doc[good], first[good], more[good], anchor[good], n_all[bound[i] : bound[j]][good]
                if not len(doc):
                    continue
                at = words.doc_start[doc] + first
                grams = G.FIRST.grams(words.fingerprints(), gram)
                yield _rows(grams[at + anchor], 0, ids[i + doc], first, more, anchor, n > 1, _joined(words, at, at + more + window))

    joined = docs.join(listed, "doc").select("doc", "text", "blocks")
    return joined.mapInArrow(released(run), _ROWS)


def _split(rows: DataFrame, window: int, gram: int, wide: int) -> DataFrame:
    """Stretches cut in ranges of ``wide`` windows, numbered by their offset from the anchor, each
    with the fingerprint of its range's number and core as key."""
    reach = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first, more, anchor, told = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5, 6))
            data, offsets = G.utf8(batch.column(7))
            words = G.Words(data, offsets)
            runs = G.SECOND.runs(words.fingerprints(G.SECOND), 1)
            least, most = anchor - more, anchor.astype(np.int64)  # offsets of the anchor in its windows
            each = most // wide - least // wide + 1
            row = np.repeat(np.arange(len(doc)), each)
            number = (least // wide)[row] + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            low, high = number * wide, np.minimum(number * wide + wide - 1, reach - 1)
            at = words.doc_start[:-1][row] + anchor[row]  # the anchor
            core = G.SECOND.spans(runs, 1, at - low, at - high + window)
            begin, stop = at - np.minimum(high, most[row]), at - np.maximum(low, least[row]) + window
            key = G.mix(core + number.astype(np.uint64) * G.U64(0x9E3779B97F4A7C15) + G.U64(wide))
            skipped = begin - words.doc_start[:-1][row]
            yield _rows(key, wide, doc[row], first[row] + skipped, stop - begin - window, anchor[row] - skipped, told[row], _joined(words, begin, stop))

    return rows.mapInArrow(released(run), _ROWS)


def _runs(doc: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(np.zeros(len(doc), np.int32))], names=["doc", "first", "more"])


def _parsed(rows: DataFrame, window: int) -> DataFrame:
    """Repeated windows found in reference blocks: whole groups, ``BLOCK`` stretches or more."""

    def settle(batch: pa.Table) -> pa.RecordBatch:
        doc, first, told = (batch.column(name).to_numpy() for name in ("doc", "first", "told"))
        words = G.Words(*G.utf8(batch.column("words")))
        stretch, offset = ReferenceBlock(words.names(), words.doc_start).repeated(window)
        new = ~told[stretch]
        return _runs(doc[stretch[new]], first[stretch[new]] + offset[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while len(held) >= BLOCK:  # up to the last change of key; a group is far smaller
                keys = held.column("key").to_numpy()
                cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                if not len(cuts):
                    break
                cut = int(cuts[min(np.searchsorted(cuts, BLOCK), len(cuts) - 1)])
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield settle(held)

    dealt = rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key", "doc", "first")
    return dealt.mapInArrow(released(run), _RUNS)


def _single(rows: DataFrame) -> DataFrame:
    """Repeated windows among rows of one window each: those whose words another row has."""
    words = F.sha2("words", 256)
    named = materialise(rows.select("doc", "first", "told", F.unhex(words).alias("content")), "single-windows")
    many = named.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    return spread_join(named.where("NOT told"), many, ["content"], "doc").select("doc", "first", F.lit(0).alias("more"))


def repeated(docs: DataFrame, checks: DataFrame, window: int, gram: int, unpack) -> DataFrame:
    """Windows (doc, first, more) of the stretches in ``checks`` that start anywhere else among them."""
    rows = materialise(stretches(docs, checks, window, gram, unpack), "stretches")
    wide, found = window - gram + 1, []
    while True:
        if wide == 1:
            found.append(_single(rows))
            break
        hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > STRETCHES).select("key"), "hot-stretches")
        n = hot.limit(BROADCAST_KEYS + 1).count()
        found.append(_parsed(rows.join(F.broadcast(hot), "key", "left_anti") if 0 < n <= BROADCAST_KEYS else rows.join(hot, "key", "left_anti") if n else rows, window))
        if not n:
            break
        wide = (wide + 1) // 2
        more = rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, "key", "left_semi")
        rows = materialise(_split(more.select("key", "wide", "doc", "first", "more", "anchor", "told", "words"), window, gram, wide), "split-stretches")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
