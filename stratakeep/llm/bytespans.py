"""Removal of repeated byte strings: every byte under a 100-byte string that also starts earlier.

Two methods find the same strings.  "anchors" groups content-defined blocks and goes down to single
strings only where blocks differ (``repeats``); "difference cover" sorts suffixes
(``suffixarray``).  The first is the default, as the second moves a row for two of three bytes.

Edge cases: a null text counts as empty; a text shorter than the string length loses nothing; rows
that repeat a doc_id are taken as one document (spans found in any of them are removed from each,
so give other texts another id); rows with a null doc_id lose nothing and are no source of copies.
The bytes left need not be valid UTF-8 and are handed on as binary.
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
from .repeats import WINDOW_SHIFT, Windows, per_document, repeated_windows
from .suffixarray import repeated

LENGTH = 100
#: Anchor k-grams in bytes, and windows in a piece where blocks differ.
GRAM, PIECE = 24, 9
_OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _spec(length: int) -> Windows:
    return Windows("byte", length, max(1, min(GRAM, length // 4)), first_stays=True, piece=min(PIECE, max(1, length // 4)))


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))


def remove(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True, method: str = "anchors") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256."""
    if not 4 <= length <= 255:
        raise ValueError("length must be between 4 and 255 bytes")
    ship(docs.sparkSession)
    source, spec = _source(docs, doc_id, text), _spec(length)
    named = source.where("doc IS NOT NULL")
    if method == "difference cover":
        windows = repeated(named, length).select("doc", F.shiftleft(F.col("at").cast("long"), WINDOW_SHIFT).alias("at"))
    else:
        windows = repeated_windows(named, spec)
    joined = per_document(source, windows, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = G.utf8(batch.column(1))
            rows = []
            for k, (begin, end) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = data[offsets[k] : offsets[k + 1]]
                kept, at, n = [], 0, 0
                for a, b in zip(begin or (), end or (), strict=True):
                    a, b = min(a, len(own)), min(b, len(own))
                    kept.append(own[at:a])
                    at, n = b, n + (b > a)
                kept.append(own[at:])
                left = np.concatenate(kept).tobytes()
                rows.append((len(own), len(own) - len(left), n, left if with_bytes else None, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = joined.select("doc", "text", "starts", "ends").mapInArrow(released(run), _OUT).withColumnRenamed("doc", "doc_id")
    return out if with_bytes else out.drop("kept")
