"""Exact search for repeated windows of a fixed number of units (bytes or words).

A window is ``length`` consecutive units of one document.  Every window picks an anchor inside
itself by winnowing (the least k-gram fingerprint), so equal windows pick equal anchors at equal
offsets.  The windows that pick one anchor are neighbours; the stretch that they cover together is
the anchor's block.

* Blocks (one for some dozens of units) are grouped by anchor and content in one exchange.  Where a
  whole block repeats, all its windows are settled at once.
* Only where one anchor stands in different blocks, which happens at the edges of repeated
  passages, one representative of each block goes on.  With ``piece`` it is cut in pieces of so many
  windows, aligned to the anchor and grouped by their core, the bytes that all windows of the piece
  share: where the core is unique nothing inside can repeat.  What is left is grouped window by
  window.  With ``factored`` the representatives are parsed against reference blocks instead.

Before each exchange equal rows of an Arrow batch collapse to the first, so a passage that a third
of all documents share sends one row a batch instead of one a document.  Reducers sort and stream:
they hold one row of a group, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from . import relative
from ._common import materialise, released, ship, width

SLICE = 1 << 18
_ROWS = "kind int, part long, h long, c long, doc long, at long, n int"
_FIELDS = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
_OUT = "kind int, doc long, at long, n int"
_OUT_FIELDS = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
COVERED, FORWARD, CHECK = 0, 1, 2
#: Where the first window stands in a packed run of windows.
WINDOW_SHIFT = 16


@dataclass(frozen=True)
class Windows:
    """What repeats: ``unit`` is "byte" or "word"; ``first_stays``: the earliest copy is no repeat;
    ``factored``: blocks that differ are factored against one another (``relative``, words only)."""

    unit: str
    length: int
    gram: int
    first_stays: bool
    piece: int = 0
    factored: bool = False

    @property
    def reach(self) -> int:
        """K-grams that a window chooses its anchor from."""
        return self.length - self.gram + 1

    @property
    def run(self) -> int:
        """Units in the runs that fingerprints of spans are made of: no span is shorter."""
        return min(64, 1 << ((self.length - max(self.piece, 1) + 1).bit_length() - 1))

    def prints(self, data: np.ndarray, offsets: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints of the first family (k-grams with ``anchors``, else runs), runs of the
        second one, and where each document's units begin."""
        size = self.gram if anchors else self.run
        if self.unit == "byte":
            return G.FIRST.byte_grams(data, size), G.SECOND.byte_grams(data, self.run), offsets
        words = G.Words(data, offsets)
        return G.FIRST.grams(words.fingerprints(G.FIRST), size), G.SECOND.grams(words.fingerprints(G.SECOND), self.run), words.doc_start


def blocks(spec: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of a slice: document index, first window, windows - 1, offset of the anchor
    in the first window, two fingerprints."""
    grams, second, start = spec.prints(data, offsets, True)
    at = G.valid_starts(start, spec.length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = least_places(grams, spec.reach)[at]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    begin = at[new]
    more = np.diff(np.append(new, len(at))) - 1
    doc = np.searchsorted(start, begin, "right") - 1
    content = G.SECOND.spans(second, spec.run, begin, begin + more + spec.length)
    return doc, begin - start[doc], more, place[new] - begin, grams[place[new]], content


def least_places(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each position, where the least (rightmost on ties) of the next ``reach`` grams stands."""
    key, place, width_ = grams, np.arange(len(grams)), 1
    while width_ < reach:
        step = min(width_, reach - width_)
        n = len(key) - step
        right = key[step:] <= key[:n]
        key = np.where(right, key[step:], key[:n])
        place = np.where(right, place[step:], place[:n])
        width_ += step
    return place


def _pack(begin: np.ndarray, more: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    """First window, windows - 1 and the anchor's offset in one number that sorts by the first."""
    return (begin.astype(np.int64) << WINDOW_SHIFT) + more * 256 + anchor


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> WINDOW_SHIFT, (at >> 8) & 255, at & 255


def _collapse(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch for the exchange: the first of each group, and later ones as settled."""
    order = np.lexsort((at, doc, c, h))
    h, c, doc, at, n = h[order], c[order], doc[order], at[order], n[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    later = (doc != doc[first][group]) | (at != at[first][group])
    many = np.logical_or.reduceat(later | (n > 1), first) if len(first) else later
    settled = later & (n < 3)
    k = np.concatenate((first, np.flatnonzero(settled)))
    kind = np.repeat([FORWARD, COVERED], [len(first), int(settled.sum())])
    count = np.concatenate((np.where(many, np.maximum(n[first], 2), n[first]), np.ones(int(settled.sum()), n.dtype)))
    part = np.where(kind == FORWARD, G.signed(h[k]), G.signed(G.mix(doc[k].astype(np.uint64))))
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), pa.array(part), pa.array(G.signed(h[k])), pa.array(G.signed(c[k])), pa.array(doc[k]), pa.array(at[k]), pa.array(count.astype(np.int32))],
        schema=_FIELDS,
    )


def _resolve(first_stays: bool, check: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream rows sorted by (kind, h, c, doc, at) and settle each group.

    Only the group that a batch ends in is carried over: its first row, whether it has several
    members, and the anchor of the group before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # h, c, doc, at, n of the open group; the h before; whether one stood before

        def close(h, c, doc, at, n, before, next_h):
            """Rows of finished groups (arrays)."""
            multi = np.zeros(len(h), bool)
            multi[1:] |= h[1:] == h[:-1]
            multi[:-1] |= h[1:] == h[:-1]
            if len(h):
                multi[0] |= before is not None and before == h[0]
                multi[-1] |= next_h is not None and next_h == h[-1]
            out = []
            if not first_stays:
                whole = (n > 1) & (n < 3)
                out.append((np.full(int(whole.sum()), COVERED), doc[whole], at[whole], n[whole]))
            if check:
                out.append((np.full(int(multi.sum()), CHECK), doc[multi], at[multi], n[multi]))
            return out

        before = None
        for batch in batches:
            kind, _, h, c, doc, at, n = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            out = []
            done = kind == COVERED
            if done.any():
                out.append((kind[done], doc[done], at[done], n[done]))
            rows = [x[~done] for x in (h, c, doc, at, n)]
            if held is not None:
                rows = [np.append(a, b) for a, b in zip(held, rows, strict=True)]
            h, c, doc, at, n = rows
            if len(h):
                head = np.ones(len(h), bool)
                head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                group = np.cumsum(head) - 1
                first = np.flatnonzero(head)
                later = (doc != doc[first][group]) | (at != at[first][group])
                settle = later & (n < 3)
                out.append((np.full(int(settle.sum()), COVERED), doc[settle], at[settle], n[settle]))
                many = np.logical_or.reduceat(later | (n > 1), first)
                size = np.where(many, np.maximum(n[first], 2), n[first])
                heads = [h[first], c[first], doc[first], at[first], size]
                held = [x[-1:] for x in heads]
                if len(first) > 1:
                    out += close(*[x[:-1] for x in heads], before, heads[0][-1])
                    before = heads[0][-2]
            yield _emit(out)
        if held is not None:
            yield _emit(close(*held, before, None))

    return run


def _emit(parts: list) -> pa.RecordBatch:
    kind, doc, at, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32))], schema=_OUT_FIELDS)


def _grouped(rows: DataFrame, spec: Windows, check: bool) -> DataFrame:
    dealt = rows.repartition(width(rows.sparkSession), "part").sortWithinPartitions("kind", "h", "c", "doc", "at")
    return dealt.mapInArrow(released(_resolve(spec.first_stays, check)), _OUT)


def _block_rows(docs: DataFrame, spec: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = G.utf8(batch.column(1))
            found = []
            for i, j in G.slices(offsets, SLICE):
                doc, begin, more, anchor, h, c = blocks(spec, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found.append((h, c, ids[i + doc], _pack(begin, more, anchor)))
            if found:
                h, c, doc, at = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield _collapse(h, c, doc, at, np.ones(len(h), np.int64))

    return docs.select("doc", "text").mapInArrow(released(run), _ROWS)


def _finer_rows(docs: DataFrame, checks: DataFrame, spec: Windows, piece: int) -> DataFrame:
    """The blocks in ``checks`` cut in pieces, or in single windows where ``piece`` is 1."""
    listed = checks.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = G.utf8(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            at_all, n_all = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "n"))
            size = np.diff(lists.offsets.to_numpy())
            bound = np.concatenate(([0], np.cumsum(size)))
            found = []
            for i, j in G.slices(offsets, SLICE):
                first, second, start = spec.prints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False)
                a, b = bound[i], bound[j]
                doc = np.repeat(np.arange(j - i), size[i:j])
                begin, more, anchor = _unpack(at_all[a:b])
                last = np.diff(start) - spec.length  # last window of each document
                good = begin + more <= last[doc]
                doc, begin, more, anchor, n = doc[good], begin[good], more[good], anchor[good], n_all[a:b][good]
                anchor = begin + anchor
                # pieces are numbered from the anchor, so that copies are cut alike
                low, high = (begin - anchor) // piece, (begin + more - anchor) // piece
                each = high - low + 1
                row = np.repeat(np.arange(len(doc)), each)
                number = low[row] + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                ideal = anchor[row] + number * piece
                own = np.maximum(ideal, 0)
                extra = np.minimum(ideal + piece - 1, last[doc[row]]) - own
                pos = start[doc[row]]
                h = G.FIRST.spans(first, spec.run, pos + ideal + piece - 1, pos + ideal + spec.length)
                c = G.SECOND.spans(second, spec.run, pos + own, pos + own + extra + spec.length)
                # where all copies count, a block that repeats is settled: its windows tell (3) but aren't marked
                told = np.where((n[row] > 1) & (not spec.first_stays), 3, 1)
                found.append((h, c, ids[i + doc[row]], _pack(own, extra), told))
            if found:
                yield _collapse(*(np.concatenate([f[k] for f in found]) for k in range(5)))

    joined = docs.join(listed, "doc").select("doc", "text", "blocks")
    return joined.mapInArrow(released(run), _ROWS)


def repeated_windows(docs: DataFrame, spec: Windows) -> DataFrame:
    """Runs of repeated windows: rows (doc, at), ``at`` packing the first
    window and how many follow it.

    ``docs`` has columns doc (long, not null) and text.  With ``first_stays`` a window counts if
    its content also starts earlier (smaller doc, or same doc and smaller start), else if it
    occurs anywhere else.
    """
    ship(docs.sparkSession)
    stages = [_grouped(_block_rows(docs, spec), spec, True)]
    if spec.factored:
        first = materialise(stages[0], "windows")
        found = relative.repeated(docs, first.where(f"kind = {CHECK}").select("doc", "at", "n"), spec.length, spec.gram, _unpack)
        packed = (F.shiftleft("first", WINDOW_SHIFT) + F.col("more") * 256).alias("at")
        return first.where(f"kind = {COVERED}").select("doc", "at").unionByName(found.select("doc", packed))
    for piece in (spec.piece, 1) if spec.piece else (1,):
        stages[-1] = materialise(stages[-1], "windows")
        checks = stages[-1].where(f"kind = {CHECK}").select("doc", "at", "n")
        stages.append(_grouped(_finer_rows(docs, checks, spec, piece), spec, piece > 1))
    parts = [s.where(f"kind = {COVERED}").select("doc", "at") for s in stages]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def per_document(docs: DataFrame, windows: DataFrame, spec: Windows) -> DataFrame:
    """``docs`` with ``runs``: the maximal runs of covered units, as [start, end) pairs in order.

    The repeated windows of one document never exceed its own units, so the list is bounded by it.
    """
    merged = windows.groupBy("doc").agg(F.array_sort(F.collect_list("at")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            bound = np.concatenate(([0], np.cumsum(size)))
            starts, ends, counts = [], [], []
            for k in range(len(size)):
                at = values[bound[k] : bound[k + 1]]
                begin, more, _ = _unpack(at)
                stop = np.maximum.accumulate(begin + more + spec.length)
                cut = np.flatnonzero(begin[1:] > stop[:-1])
                starts.append(begin[np.append(0, cut + 1)])
                ends.append(stop[np.append(cut, len(at) - 1)])
                counts.append(len(cut) + 1)
            off = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, flat(starts)), pa.ListArray.from_arrays(off, flat(ends))], names=["doc", "starts", "ends"])

    runs = merged.select("doc", "windows").mapInArrow(released(run), "doc long, starts array<long>, ends array<long>")
    return docs.join(runs, "doc", "left")
