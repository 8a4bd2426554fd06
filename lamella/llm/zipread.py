"""Range reads of stored members of a ZIP archive: end record, ZIP64 records and central directory, parsed as published in the ZIP application note."""

from __future__ import annotations

import struct
from dataclasses import dataclass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipRanges:
    """An archive behind a random-access file (read(n), seek(pos), size()). Only the directory and what is asked for are read."""

    def __init__(self, f):
        self.f = f
        self.length = f.size()
        self.members = {m.name: m for m in self._directory()}

    def at(self, pos: int, n: int) -> bytes:
        if pos < 0 or n < 0 or pos + n > self.length:
            raise ValueError(f"range {pos}+{n} is outside an archive of {self.length} bytes")
        self.f.seek(pos)
        return self.f.read(n)

    def _directory(self):
        tail = self.at(max(0, self.length - 65_557), min(self.length, 65_557))
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the bytes of the mark may stand in the comment
        if end < 0:
            raise ValueError("no end record: not a ZIP archive, or cut short")
        count, size, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (size, start):
            where = self.length - len(tail) + end - 20
            mark, _, end64 = struct.unpack("<4sIQ", self.at(where, 16))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator where the end record asks for one")
            head = self.at(end64, 56)
            if head[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, size, start = struct.unpack_from("<QQQ", head, 32)
        block, pos = self.at(start, size), 0
        for _ in range(count):
            if block[pos : pos + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", block, pos + 10)
            stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", block, pos + 20)
            header, = struct.unpack_from("<I", block, pos + 42)
            name = block[pos + 46 : pos + 46 + n_name].decode()
            extra = block[pos + 46 + n_name : pos + 46 + n_name + n_extra]
            at = 0
            while at + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, at)
                if kind == 1:  # ZIP64: only the fields that overflow, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header = next(wide) if header == 0xFFFFFFFF else header
                at += 4 + n
            yield Member(name, method, plain, stored, header)
            pos += 46 + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin; its own header says how long its name and extra field are."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is packed by method {m.method}; only stored members can be read by range")
        head = self.at(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n_name + n_extra

    def read(self, name: str, pos: int = 0, n: int | None = None) -> bytes:
        m = self.members[name]
        n = m.size - pos if n is None else n
        if pos < 0 or n < 0 or pos + n > m.size:
            raise ValueError(f"range {pos}+{n} is outside {name} of {m.size} bytes")
        return self.at(self.start(name) + pos, n)
