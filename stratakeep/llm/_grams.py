"""Vectorised text kernels over Arrow string buffers: words, k-grams, winnowed anchors.

Everything works on the UTF-8 bytes of a slice of documents, so no Python object is made per
word.  Fingerprints depend on content alone: eight bytes at a time are packed into a number, which
is exact, and numbers are chained by ``mix``, a bijection of 64 bits that is no polynomial, so that
strings built to cancel out under sums of powers (Thue-Morse words, say) differ here.  Two families
with keys of their own are independent; where a decision rests on fingerprints alone, both are
compared (128 bits).  ``names`` gives exact numbers in place of fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Family:
    """One keyed family of fingerprints of byte strings and of strings of numbers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.key, self.by, self.start = (U64(int(x)) for x in rng.integers(1 << 62, size=3, dtype=np.uint64) * U64(2) + U64(1))
        self.salt = int(self.key).to_bytes(8, "little")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Fingerprint of two neighbouring runs from theirs; which is first matters."""
        return mix(left * self.by + (right ^ self.key))

    def runs(self, values: np.ndarray, size: int) -> np.ndarray:
        """Fingerprint of the ``size`` numbers (a power of two) from each position on."""
        out, width = mix(values ^ self.start), 1
        while width < size:
            out = self.join(out[: max(0, len(out) - width)], out[width:])
            width *= 2
        return out

    def grams(self, values: np.ndarray, k: int) -> np.ndarray:
        """Fingerprint of the k numbers from each position on (len - k + 1 of them)."""
        if len(values) < k:
            return np.zeros(0, U64)
        run = self.runs(values, 1 << (k.bit_length() - 1))
        return run if k & (k - 1) == 0 else self.join(run[: len(values) - k + 1], run[len(run) - (len(values) - k + 1) :])

    def byte_grams(self, data: np.ndarray, k: int) -> np.ndarray:
        """Fingerprint of the k bytes from each position on (len - k + 1 of them)."""
        if len(data) < k:
            return np.zeros(0, U64)
        eight = packed(data)
        if k < 8:
            return mix((eight[: len(data) - k + 1] & MASKS[k]) ^ self.start)
        # runs of eight bytes, eight apart, and one at the end where k is no multiple
        out, width = mix(eight[: len(data) - 7] ^ self.start), 8
        while 2 * width <= k:
            out = self.join(out[: max(0, len(out) - width)], out[width:])
            width *= 2
        n = len(data) - k + 1
        return out if width == k else self.join(out[:n], out[k - width : k - width + n])

    def spans(self, runs: np.ndarray, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprint of [start, end) for spans of ``size`` values at least, from ``runs`` of so
        many: runs side by side, the last one flush with the end."""
        length = (end - start).astype(np.int64)
        out = mix(length.astype(U64) ^ self.start)
        at, todo = start.astype(np.int64), np.arange(len(out))
        while len(todo):
            last = end[todo] - at[todo] <= size
            place = np.where(last, end[todo] - size, at[todo])
            out[todo] = self.join(out[todo], runs[place])
            at[todo] += size
            todo = todo[~last]
        return out

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprint of each byte string [start, end)."""
        length = end - start
        out = mix(length.astype(U64) ^ self.start)
        eight = packed(data)
        todo = np.flatnonzero(length <= LONG_WORD)
        at, left = start[todo], length[todo]
        while len(todo):
            out[todo] = self.join(out[todo], eight[at] & MASKS[np.minimum(left, 8)])
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > LONG_WORD):
            digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=self.salt).digest()
            out[i] = U64(int.from_bytes(digest, "little"))
        return out


#: The first k bytes of eight.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the data."""
    padded = np.zeros((len(data) // 8 + 2) * 8 + 8, np.uint8)
    padded[: len(data)] = data
    out = np.empty((len(data) // 8 + 2, 8), U64)
    for r in range(8):
        out[:, r] = padded[r : r + 8 * len(out)].view("<u8")
    return out.ravel()[: len(data) + 1]


FIRST, SECOND = Family(11), Family(12)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    _, offsets, data = binary.buffers()
    if len(binary) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words (maximal runs without ASCII white space) of a slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n_docs = len(offsets) - 1
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~WHITE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        left = np.empty(n, bool)
        left[:1] = False
        left[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~left | cut[:n]))
        right = np.zeros(n, bool)
        right[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~right | cut[1:])) + 1
        self.doc_start = np.searchsorted(self.start, offsets)  # of words; n_docs + 1 of them
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.doc_start))

    def __len__(self) -> int:
        return len(self.start)

    def fingerprints(self, family: Family = FIRST) -> np.ndarray:
        return family.words(self.data, self.start, self.end)

    def names(self) -> np.ndarray:
        """A number for each word, equal for equal words only."""
        size = self.end - self.start
        at = np.concatenate(([0], np.cumsum(size)))
        inside = np.repeat(self.start - at[:-1], size) + np.arange(at[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[inside]))])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def gram_names(names: np.ndarray, k: int) -> np.ndarray:
    """A number for the k numbers from each position on, equal for equal ones only.

    Names of two runs are sorted as a pair and numbered anew, so nothing is hashed: runs of 1, 2,
    4, ... up to k, the last one overlapping.
    """
    out, width = names, 1
    while width < k and len(out):
        step = min(width, k - width)
        pair = (out[: max(0, len(out) - step)] << 32) | out[step:]
        out = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    return out if width == k else np.zeros(0, np.int64)


def valid_starts(doc_start: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k items stay in one document, ascending."""
    counts = np.maximum(np.diff(doc_start) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(doc_start[:-1] - (ends - counts), counts)


def winnow(grams: np.ndarray, doc_start: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the least k-gram fingerprint of every run of ``window`` k-grams in a document.

    The rightmost least one is taken, so two equal stretches of k + window - 1 items always keep
    the same anchors.  Documents with fewer k-grams than ``window`` have none.
    """
    span = k + window - 1
    starts = valid_starts(doc_start, span)
    if not len(starts):
        return starts
    key = grams.copy()
    place = np.arange(len(key), dtype=np.int64)
    width = 1
    while width < window:  # sparse-table doubling
        step = min(width, window - width)
        n = len(key) - step
        take = key[step:] <= key[:n]
        key = np.where(take, key[step:], key[:n])
        place = np.where(take, place[step:], place[:n])
        width += step
    chosen = place[starts]
    keep = np.empty(len(chosen), bool)
    keep[:1] = True
    keep[1:] = chosen[1:] != chosen[:-1]
    return np.unique(chosen[keep])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def spans_of(mask_starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) over ascending starts, as disjoint maximal runs."""
    if not len(mask_starts):
        return mask_starts, mask_starts
    gap = np.flatnonzero(np.diff(mask_starts) > length)
    first = np.concatenate(([0], gap + 1))
    last = np.concatenate((gap, [len(mask_starts) - 1]))
    return mask_starts[first], mask_starts[last] + length
