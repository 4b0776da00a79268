"""PE files: sections, imports, exports and the strings of resources."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import ClassVar

from .base import ParseError, Parsed, Reader

# Of the public format (fixed values).
CODE, WRITE = 0x20, 0x80000000
STRING_TABLE, VERSION, MANIFEST = 6, 16, 24
DIRECTORY_ENTRY = 0x80000000


@dataclass(frozen=True)
class Pe:
    """The switches choose which resources give texts."""

    version_info: bool = True
    manifests: bool = True
    string_tables: bool = True
    name: ClassVar[str] = "Pe"

    def detect(self, data: bytes) -> bool:
        at = int.from_bytes(data[60:64], "little")
        return data[:2] == b"MZ" and len(data) >= 64 and data[at : at + 4] == b"PE\0\0"

    def parse(self, data: bytes):
        if not self.detect(data):
            raise ParseError("not a PE header")
        r = Reader(data)
        coff = r.get(60, "I")[0] + 4
        _, count, _, _, _, optional, _ = r.get(coff, "HHIIIHH")
        head = coff + 20
        wide = optional >= 2 and r.get(head, "H")[0] == 0x20B
        many = head + (108 if wide else 92)
        directories = []
        if optional >= many - head + 4:
            n = min(r.get(many, "I")[0], 16, (head + optional - many - 4) // 8)
            directories = [r.get(many + 4 + 8 * i, "II") for i in range(n)]
        out, places = Parsed(), []
        for i in range(count):
            at = head + optional + 40 * i
            name, virtual, address, size, offset = *r.get(at, "8s"), *r.get(at + 8, "IIII")
            flags = r.get(at + 36, "I")[0]
            places.append((address, max(virtual, size), offset, size))
            if size == 0:
                continue
            if offset + size > len(data):
                raise ParseError(f"section {i} ends outside the file")
            text = name.decode("utf-8", "replace").rstrip("\0")
            out.sections.append((i, text, None, flags, offset, size, size, address, bool(flags & CODE), bool(flags & WRITE)))

        def at_rva(rva: int) -> int | None:
            for address, length, offset, size in places:
                if address <= rva < address + length and rva - address < size:
                    return offset + rva - address
            return None

        if len(directories) > 0 and directories[0][0]:
            self._exports(r, at_rva, directories[0][0], out)
        if len(directories) > 1 and directories[1][0]:
            self._imports(r, at_rva, directories[1][0], wide, out)
        if len(directories) > 2 and directories[2][0]:
            self._resources(r, at_rva, directories[2][0], out)
        return out

    def _imports(self, r, at_rva, rva: int, wide: bool, out) -> None:
        at, kind, size, flag = at_rva(rva), "Q" if wide else "I", 8 if wide else 4, 1 << (63 if wide else 31)
        while at is not None:
            lookup, _, _, library, address = r.get(at, "IIIII")
            at += 20
            if not library and not lookup and not address:
                return
            name_at, entry = at_rva(library), at_rva(lookup or address)
            dll = r.name(name_at) if name_at is not None else None
            while entry is not None:
                if len(out.imports) * size > len(r.data):
                    raise ParseError("import tables overlap")
                value = r.get(entry, kind)[0]
                entry += size
                if not value:
                    break
                if value & flag:
                    out.imports.append((f"ORDINAL {value & 0xFFFF}", dll, 0))
                elif (hint := at_rva(value & 0x7FFFFFFF)) is not None:
                    out.imports.append((r.name(hint + 2), dll, value & 0x7FFFFFFF))

    def _exports(self, r, at_rva, rva: int, out) -> None:
        at = at_rva(rva)
        if at is None:
            return
        functions, names = r.get(at + 20, "II")
        table, pointers, ordinals = (at_rva(x) for x in r.get(at + 28, "III"))
        named: dict = {}
        for i in range(names if pointers is not None and ordinals is not None else 0):
            place = at_rva(r.get(pointers + 4 * i, "I")[0])
            if place is not None:
                named.setdefault(r.get(ordinals + 2 * i, "H")[0], r.name(place))
        for i in range(functions if table is not None else 0):
            address = r.get(table + 4 * i, "I")[0]
            if address:
                n = len(out.exports)
                out.exports.append((named.get(i) or f"ordinal_{n}", address, n & 0xFFFF))

    def _resources(self, r, at_rva, rva: int, out) -> None:
        base = at_rva(rva)
        if base is None:
            return

        def entries(at: int):
            named, numbered = r.get(at + 12, "HH")
            return [r.get(at + 16 + 8 * i, "II") for i in range(named + numbered)]

        def leaves(at: int, depth: int):
            for _, to in entries(at) if depth < 4 else ():
                if to & DIRECTORY_ENTRY:
                    yield from leaves(base + (to & 0x7FFFFFFF), depth + 1)
                else:
                    address, size = r.get(base + to, "II")
                    place = at_rva(address)
                    if place is not None and place + size <= len(r.data):
                        yield place, size

        wanted = [k for k, on in ((STRING_TABLE, self.string_tables), (VERSION, self.version_info), (MANIFEST, self.manifests)) if on]
        for kind, to in entries(base):
            if kind not in wanted or not to & DIRECTORY_ENTRY:
                continue
            for place, size in leaves(base + (to & 0x7FFFFFFF), 1):
                body = r.data[place : place + size]
                if kind == MANIFEST:
                    out.texts.append(("ResourceString", body.decode("utf-8", "replace").strip("\0﻿"), "utf-8", place))
                elif kind == STRING_TABLE:
                    out.texts += self._table(body, place)
                else:
                    out.texts += self._wide(body, place)

    @staticmethod
    def _table(body: bytes, place: int) -> list:
        """Sixteen strings, each its length and UTF-16 units."""
        found, at = [], 0
        while at + 2 <= len(body):
            n = 2 * int.from_bytes(body[at : at + 2], "little")
            text = body[at + 2 : at + 2 + n].decode("utf-16-le", "replace")
            if text:
                found.append(("ResourceString", text, "utf-16le", place + at + 2))
            at += 2 + n
        return found

    @staticmethod
    def _wide(body: bytes, place: int) -> list:
        """Runs of UTF-16LE text in a version block."""
        return [("ResourceString", m[0].decode("utf-16-le"), "utf-16le", place + m.start()) for m in re.finditer(rb"(?:[\x20-\x7E]\x00){3,}", body) if m.start() % 2 == 0]
