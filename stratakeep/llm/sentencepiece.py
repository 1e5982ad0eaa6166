"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation walks the compiled character map (a double-array trie over UTF-8) with
longest-prefix matches and notes, for every byte that it emits, the source byte it came from.
White space is escaped, the dummy prefix added and surplus space dropped as the model's normaliser
asks.  Ids come from the ``sentencepiece`` library, which is given the raw text: cut where no piece
of the vocabulary can cross, each different stretch once, if the model allows it, else whole texts.
Every piece is laid on the normalised text and projected through the alignment onto a byte span of
the original text.  Models without a character map, whose normalised text differs in spaces only,
have the spans of a whole batch computed at once; others go document by document.

Edge cases: a null text counts as empty; an empty text has no ids and no spans; texts of any
length are encoded whole; repeated rows give repeated results; columns of the input are kept and
the output columns replace ones of the same name.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import released, ship

SPACE = "▁"
REPLACEMENT = "�".encode()
CACHE_ENTRIES = 150_000
#: Texts that are encoded together.
ROWS_AT_ONCE = 128
#: Stretches of more characters are not kept in the cache.
CACHED_CHARS = 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, int or bytes)."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


@dataclass
class NormalizerSpec:
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> NormalizerSpec:
        out = cls()
        for number, value in _fields(data):
            if number == 2:
                out.charsmap = value
            elif number == 3:
                out.add_dummy_prefix = bool(value)
            elif number == 4:
                out.remove_extra_whitespaces = bool(value)
            elif number == 5:
                out.escape_whitespaces = bool(value)
        return out


class CharacterMap:
    """The compiled character map: a double-array trie and a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key that ``text`` has at ``at`` and its pool offset; or (0, -1)."""
        units = self.units
        if not units:
            return 0, -1
        found, value, node, unit = 0, -1, 0, units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value, found = units[node] & ((1 << 31) - 1), i + 1 - at
        return found, value

    def replacement(self, offset: int) -> bytes:
        return self.pool[offset : self.pool.index(b"\0", offset)]


def _char_length(text: bytes, at: int) -> tuple[int, bool]:
    """Bytes of the UTF-8 character at ``at`` (1 if malformed), and whether it is well formed."""
    lead = text[at]
    size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if size and at + size <= len(text):
        try:
            text[at : at + size].decode()
            return size, True
        except UnicodeDecodeError:
            pass
    return 1, False


class Normalizer:
    def __init__(self, spec: NormalizerSpec, protected: tuple[str, ...] = ()):
        self.spec = spec
        self.map = CharacterMap(spec.charsmap)
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "
        self.protected = sorted((p.encode() for p in protected), key=len, reverse=True)
        self.plain = not spec.charsmap and not self.protected

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest known prefix at ``at`` and how many bytes it stands for."""
        for symbol in self.protected:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        size, value = self.map.longest(text, at)
        if size:
            return self.map.replacement(value), size
        size, good = _char_length(text, at)
        return (text[at : at + size] if good else REPLACEMENT), size

    def normalize(self, text: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them (and the end) the offset of its source."""
        spec, space = self.spec, self.space
        out, align = bytearray(), []
        at = 0
        if spec.remove_extra_whitespaces:
            while at < len(text):
                piece, size = self._prefix(text, at)
                if piece != b" ":
                    break
                at += size
        if at >= len(text):
            return b"", [at]
        if spec.add_dummy_prefix:
            out += space
            align += [at] * len(space)
        after_space = spec.remove_extra_whitespaces
        while at < len(text):
            piece, size = self._prefix(text, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space)
                out += shown
                align += [at] * len(shown)
                if spec.remove_extra_whitespaces:
                    after_space = piece.endswith(b" ")
            at += size
        if spec.remove_extra_whitespaces:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        align.append(at)
        return bytes(out), align


class Encoder:
    """One model file: normaliser, vocabulary, pieces with spans, decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        with open(model_path, "rb") as file:
            data = file.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec, protected = NormalizerSpec(), []
        self.kinds: list[int] = []
        self.pieces: list[str] = []
        suffix = False
        for number, value in _fields(data):
            if number == 1:
                fields = dict(_fields(value))
                self.pieces.append(fields.get(1, b"").decode())
                self.kinds.append(fields.get(3, 1))
                if self.kinds[-1] == 4:
                    protected.append(self.pieces[-1])
            elif number == 2:
                suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = NormalizerSpec.parse(value)
        self.normalizer = Normalizer(spec, tuple(protected))
        #: Bytes of each piece in the normalised text; unknown ones have no length of their own.
        self.sizes = np.array([1 if kind == 6 else 0 if kind == 2 else len(p.encode()) for p, kind in zip(self.pieces, self.kinds)], np.int64)
        self.unknown = np.array([kind == 2 for kind in self.kinds], bool)
        #: Stretches "spaces, then others" are independent if no piece has a space after another.
        self.cuts = (
            self.normalizer.plain and spec.escape_whitespaces and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not suffix
            and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, kind in zip(self.pieces, self.kinds) if kind == 1)
        )
        #: A single space at the end of a text: the processor would take it for an empty text.
        self.lone = [self.pieces.index(SPACE)] if SPACE in self.pieces else []
        self.cuts = self.cuts and bool(self.lone)
        self.cache: dict[str, list[int]] = {"": self.lone}

    def encode_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.

        A stretch is named by its text without the leading space.  New ones are encoded together,
        once a call; the cache keeps the first ones seen, which are the frequent ones, and stays
        as it is when it is full.
        """
        if not self.cuts:
            return self.processor.encode(texts, num_threads=1)
        every = []
        for text in texts:
            parts = text.split(" ")
            if SPACE in text:  # written out in the text it cuts as a space does
                parts = [p[1:] for p in re.findall("[ ▁]+[^ ▁]*", " " + text)]
            elif "" in parts:
                parts = [p[1:] for p in re.findall(" +[^ ]*", " " + text)] if text else []
            every.append(parts)
        flat = list(chain.from_iterable(every))
        found = list(map(self.cache.get, flat))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            new = list({flat[i] for i in gaps})
            fresh = dict(zip(new, self.processor.encode(new, num_threads=1), strict=True))
            for i in gaps:
                found[i] = fresh[flat[i]]
            self.cache.update([(p, fresh[p]) for p in new if len(p) <= CACHED_CHARS][: CACHE_ENTRIES - len(self.cache)])
        out, at = [], 0
        for parts in every:
            out.append(list(chain.from_iterable(found[at : at + len(parts)])))
            at += len(parts)
        return out

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Byte spans of the original text, one for each id, in order and without gaps inside."""
        raw = text.encode()
        normalized, align = self.normalizer.normalize(raw) if not self.normalizer.plain or not self.cuts else self._plain(raw)
        begin, end, at = [], [], 0
        for i in ids:
            if self.kinds[i] == 6:  # a byte
                size = 1
            elif self.kinds[i] == 2:  # unknown: as far as the next piece that is found
                size = 0
            else:
                size = len(self.pieces[i].encode())
            begin.append(at)
            at += size
            end.append(at)
        if any(self.kinds[i] == 2 for i in ids):
            begin, end = self._around_unknown(normalized, ids)
        return [align[b] for b in begin], [align[e] for e in end]

    def spans_of(self, texts: list[str], ids: list[list[int]]) -> tuple[pa.Array, pa.Array]:
        """``spans`` of many texts, as two arrays of lists."""
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        if not self.cuts or self.unknown[flat].any():
            both = [self.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            return _lists([x[0] for x in both]), _lists([x[1] for x in both])
        raws = [t.encode() for t in texts]
        lengths = np.array([len(r) + 2 for r in raws], np.int64)
        starts = np.cumsum(lengths) - lengths
        # the prefix before each text and a byte for its end
        data = np.frombuffer(b"".join(b" " + r + b"." for r in raws), np.uint8)
        repeat = np.where(data == 32, len(SPACE.encode()), 1)
        source = np.maximum(np.arange(len(data)) - np.repeat(starts, lengths) - 1, 0).astype(np.int32)
        align = np.repeat(source, repeat)
        size = self.sizes[flat]
        stop = np.concatenate(([0], np.cumsum(size)))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        first = (np.cumsum(repeat) - repeat)[starts]
        end = stop[1:] + np.repeat(first - stop[offsets[:-1]], counts)
        at = pa.array(offsets.astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(align[end - size])), pa.ListArray.from_arrays(at, pa.array(align[end]))

    def _around_unknown(self, normalized: bytes, ids: list[int]) -> tuple[list[int], list[int]]:
        proto = self.pieces
        begin, end, at = [], [], 0
        for k, i in enumerate(ids):
            begin.append(at)
            if self.kinds[i] == 2:
                after = next((j for j in ids[k + 1 :] if self.kinds[j] not in (2, 6)), None)
                stop = normalized.find(proto[after].encode(), at + 1) if after is not None else len(normalized)
                at = stop if stop >= 0 else len(normalized)
            elif self.kinds[i] == 6:
                at += 1
            else:
                at += len(proto[i].encode())
            end.append(at)
        return begin, end

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The alignment without a character map: only spaces change their length."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        repeat = np.where(data == 32, len(SPACE.encode()), 1)
        align = np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(data)), repeat), [len(data)]))
        return SPACE.encode() + raw.replace(b" ", SPACE.encode()), align

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


@lru_cache(maxsize=4)
def encoder(model_path: str) -> Encoder:
    return Encoder(model_path)


_OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "begin": T.ArrayType(T.IntegerType(), False),
    "end": T.ArrayType(T.IntegerType(), False),
    "decoded": T.StringType(),
}


def encode(df: DataFrame, model_path: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "begin", "end"), keep: list[str] | None = None) -> DataFrame:
    """Add ``outputs`` to ``df``: ids, begin and end (byte spans of the text), decoded.

    A narrow map over Arrow batches: no exchange, one model a worker, memory bounded by a batch
    and a cache of ``CACHE_ENTRIES`` short stretches.  ``keep`` names the columns to carry.
    """
    ship(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    fields = [T.StructField(c, df.schema[c].dataType) for c in kept] + [T.StructField(o, _OUTPUTS[o]) for o in outputs]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    inner = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields[: len(kept)])] + [T.StructField(f"o_{o}", _OUTPUTS[o]) for o in outputs])
    names = [f.name for f in inner.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = batch.column(len(kept)).to_pylist()
                ids = model.encode_ids(texts)
                made = {"ids": ids}
                if "begin" in outputs or "end" in outputs:
                    made["begin"], made["end"] = model.spans_of(texts, ids)
                if "decoded" in outputs:
                    made["decoded"] = model.decode(ids)
                columns = [pa.array(made[o], pa.string()) if o == "decoded" else _lists(made[o]) if o == "ids" else made[o] for o in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, names=names)

    mapped = source.mapInArrow(released(run), inner)
    return mapped.select(*[F.col(a.name).alias(b.name) for a, b in zip(inner.fields, fields, strict=True)])


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(values), np.int32, int(offsets[-1]))))


def decode(df: DataFrame, model_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids decode to the empty text."""
    ship(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def to_text(column: pd.Series) -> pd.Series:
        return pd.Series(encoder(model_path).decode([[] if x is None else [int(i) for i in x] for x in column]), dtype=object)

    return df.withColumn(output, to_text(F.col(f"`{ids}`")))
