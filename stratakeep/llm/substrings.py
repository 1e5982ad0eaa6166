"""Removal of repeated word windows by relative Lempel-Ziv parsing against indexed reference blocks.

1. Every window of words is named by its anchor, the least fingerprint of the 9-word runs in it;
   neighbouring windows of one anchor form a stretch.  Stretches are grouped by anchor and content
   (two independent 64-bit fingerprints): one that stands elsewhere as a whole is a factor as it is,
   and one copy of each goes on where an anchor has several different stretches.
2. These are factored greedily against the reference blocks that hold their anchor (``relative``):
   longest matches of words from a suffix array, factors of at least the window's length are
   duplicate spans, and windows across factor boundaries are looked up one by one.
3. Touching and overlapping windows join to duplicate spans; none is shorter than the window.

Edge cases: a null or wordless text has no words and loses none; a document shorter than the
window loses nothing; rows that repeat a doc_id are taken as one document (give other texts
another id: spans found in any of them are removed from each); rows with a null doc_id neither
lose words nor count as a copy.  Words are kept as they are, including their letter case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._common import released, ship
from .repeats import Windows, per_document, repeated_windows

WINDOW = 35
GRAM = 9
_OUT = "doc long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _spec(window: int) -> Windows:
    return Windows("word", window, min(GRAM, window), first_stays=False, factored=True)


def spans(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Duplicate spans in words: doc_id, starts, ends (arrays; null where there is none)."""
    source = _source(docs, doc_id, text)
    spec = _spec(window)
    return per_document(source.select("doc"), repeated_windows(source.where("doc IS NOT NULL"), spec), spec).withColumnRenamed("doc", "doc_id")


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))


def remove(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text, kept_sha256.

    ``kept_text`` is the words left, joined by one space; without ``with_text`` only its digest
    comes back.  ``keep`` names columns to carry along, which saves a join with the documents.
    """
    ship(docs.sparkSession)
    carried = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), *carried)
    spec = _spec(window)
    joined = per_document(source, repeated_windows(source.where("doc IS NOT NULL"), spec), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = G.utf8(batch.column(1))
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in G.slices(offsets):
                cut = _cut(batch.column(0).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], starts[i:j], ends[i:j], with_text)
                yield pa.RecordBatch.from_arrays([*cut.columns, *(c.slice(i, j - i) for c in batch.columns[4:])], names=[*cut.schema.names, *batch.schema.names[4:]])

    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([_OUT, *(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))])
    out = joined.select("doc", "text", "starts", "ends", *names).mapInArrow(released(run), schema)
    found = ["n_words", "n_removed", *(["kept_text"] if with_text else []), "kept_sha256"]
    return out.select(F.col("doc").alias("doc_id"), *found, *[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)])


def _cut(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, starts: list, ends: list, with_text: bool) -> pa.RecordBatch:
    words = G.Words(data, offsets)
    counts = np.diff(words.doc_start)
    flags = np.zeros(len(words) + 1, np.int64)
    for k, begin in enumerate(starts):
        if begin:
            np.add.at(flags, words.doc_start[k] + np.minimum(begin, counts[k]), 1)
            np.add.at(flags, words.doc_start[k] + np.minimum(ends[k], counts[k]), -1)
    keep = np.cumsum(flags[:-1]) == 0
    kept = np.concatenate(([0], np.cumsum(keep)))[words.doc_start]
    # bytes of kept words and of one space after each
    edge = np.zeros(len(data) + 1, np.int64)
    edge[words.start[keep]] += 1
    edge[words.end[keep]] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    size = (words.end - words.start)[keep] + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    stop = np.cumsum(size)
    body = np.ones(len(out), bool)
    body[stop - 1] = False
    out[body] = data[inside]
    at = np.concatenate(([0], stop))[kept]
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(counts.astype(np.int64)),
            pa.array(counts - np.diff(kept)),
            pa.array([t.decode("utf-8", "replace") for t in texts] if with_text else [None] * len(texts), pa.string()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ],
        names=["doc", "n_words", "n_removed", "kept_text", "kept_sha256"],
    )
