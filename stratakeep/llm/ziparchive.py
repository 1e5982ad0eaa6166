"""ZIP containers with stored members, written as a stream and read by byte ranges.

The reader takes only the end of a file, its central directory and the ranges asked for; ZIP64
directories and sizes are understood.  Nothing is unpacked to disk.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DOS_DATE = (1980 - 1980) << 9 | 1 << 5 | 1


class Writer:
    """Appends stored members to an output stream.  ``zip64`` forces the 64-bit records."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Returns the offset of the member's first data byte."""
        raw, crc, size, start = name.encode(), zlib.crc32(data), len(data), self.at
        big = self.zip64 or size >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _MAX32 if big else size
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        data_at = self.at
        self._put(data)
        self.entries.append((raw, crc, size, start))
        return data_at

    def close(self) -> int:
        start = self.at
        for raw, crc, size, offset in self.entries:
            big = self.zip64 or size >= _MAX32 or offset >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            shown, at = (_MAX32, _MAX32) if big else (size, offset)
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        length, n = self.at - start, len(self.entries)
        if self.zip64 or n >= _MAX16 or start >= _MAX32 or length >= _MAX32:
            end64 = self.at
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, _MAX16), min(n, _MAX16), min(length, _MAX32), min(start, _MAX32), 0))
        return self.at


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    header_at: int


class Reader:
    """``file`` offers size() and read_at(n, offset), as pyarrow's input files do."""

    def __init__(self, file):
        self.file = file
        self.size = file.size()
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - (22 + _MAX16))
        tail = bytes(self.file.read_at(self.size - tail_at, tail_at))
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at + 3)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP container")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if _MAX16 == n or _MAX32 in (length, start):
            locator = bytes(self.file.read_at(20, tail_at + at - 20))
            if locator[:4] == _LOCATOR64:
                record = bytes(self.file.read_at(56, struct.unpack_from("<Q", locator, 8)[0]))
                if record[:4] != _END64:
                    raise ValueError("broken ZIP64 end of central directory")
                n, length, start = struct.unpack_from("<QQQ", record, 32)
        data, out, at = bytes(self.file.read_at(length, start)), [], 0
        for _ in range(n):
            if data[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            method, crc, packed, size, names, extras, notes, offset = (struct.unpack_from(f, data, at + p)[0] for f, p in (("<H", 10), ("<I", 16), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
            name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
            extra = data[at + 46 + names : at + 46 + names + extras]
            if _MAX32 in (size, packed, offset):
                size, packed, offset = _wide(extra, size, packed, offset)
            out.append(Member(name, method, crc, size if method else packed, offset))
            at += 46 + names + extras + notes
        return out

    def data_at(self, name: str) -> int:
        """Offset of a stored member's first byte in the file."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed in its container; only stored members are read by range")
        header = bytes(self.file.read_at(30, member.header_at))
        if header[:4] != _LOCAL:
            raise ValueError(f"no local header for {name}")
        names, extras = struct.unpack_from("<HH", header, 26)
        return member.header_at + 30 + names + extras

    def read(self, name: str, check: bool = True) -> bytes:
        data = bytes(self.file.read_at(self.members[name].size, self.data_at(name)))
        if check and zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"checksum of {name} differs")
        return data


def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values, k = [size, packed, offset], at + 4
            for i, v in enumerate(values):
                if v == _MAX32:
                    values[i] = struct.unpack_from("<Q", extra, k)[0]
                    k += 8
            return tuple(values)
        at += 4 + length
    return size, packed, offset
