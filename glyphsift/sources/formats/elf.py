"""ELF files: sections, symbols that are imported or exported, and on request notes and dynamic strings."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from .base import ParseError, Parsed, Reader

# Of the public format (fixed values).
MAGIC = b"\x7fELF"
SYMTAB, STRTAB, DYNAMIC, NOTE, NOBITS, DYNSYM = 2, 3, 6, 7, 8, 11
BUILD_ID = 3
DYNAMIC_TEXTS = (1, 14, 15, 29)  # needed library, own name, two search paths
EXECUTE, WRITE = 0x4, 0x1
GLOBAL, FUNCTION, UNDEFINED = 1, 2, 0


@dataclass(frozen=True)
class Elf:
    """``notes``: owners of notes; ``build_id``: build ids in hexadecimal digits; ``dynamic``: libraries and search paths; ``symtab``: static symbols too."""

    notes: bool = False
    build_id: bool = False
    dynamic: bool = False
    symtab: bool = False
    name: ClassVar[str] = "Elf"

    def detect(self, data: bytes) -> bool:
        return data[:4] == MAGIC and len(data) >= 52

    def parse(self, data: bytes):
        if not self.detect(data) or data[4] not in (1, 2) or data[5] not in (1, 2):
            raise ParseError("not an ELF header")
        wide = data[4] == 2
        r = Reader(data, "<" if data[5] == 1 else ">")
        if wide:
            (table,), (entry, count, names) = r.get(40, "Q"), r.get(58, "HHH")
        else:
            (table,), (entry, count, names) = r.get(32, "I"), r.get(46, "HHH")
        kinds, size = ("IIQQQQIIQQ", 64) if wide else ("IIIIIIIIII", 40)
        out, rows = Parsed(), []
        if table:
            if entry < size:
                raise ParseError("section headers are too short")
            first = r.get(table, kinds)
            count = count or first[5]  # large counts stand in the first header
            names = first[6] if names == 0xFFFF else names
            if count * entry > len(data):
                raise ParseError("section headers end outside the file")
            rows = [r.get(table + i * entry, kinds) for i in range(count)]
        strings = rows[names] if names < len(rows) else None
        for i, (name, kind, flags, address, offset, length, *_) in enumerate(rows):
            if length == 0:
                continue
            if kind != NOBITS and offset + length > len(data):
                raise ParseError(f"section {i} ends outside the file")
            text = r.name(strings[4] + name, strings[4] + strings[5]) if strings else None
            out.sections.append((i, text or f"section_{i}", None, flags, offset, 0 if kind == NOBITS else length, length, address, bool(flags & EXECUTE), bool(flags & WRITE)))
        for row in rows:
            if row[1] == DYNSYM or (self.symtab and row[1] == SYMTAB):
                self._symbols(r, row, rows, wide, out)
            elif (self.notes or self.build_id) and row[1] == NOTE:
                self._notes(r, row[4], row[4] + row[5], out)
            elif self.dynamic and row[1] == DYNAMIC and row[6] < len(rows):
                self._dynamic(r, row, rows[row[6]], wide, out)
        return out

    def _notes(self, r, at: int, end: int, out) -> None:
        """Owners and build ids of notes; a note that doesn't fit ends the section."""
        while at + 12 <= end:
            name, size, kind = r.get(at, "III")
            body = at + 12 + (name + 3 & ~3)
            if body + size > end:
                return
            owner = r.name(at + 12, at + 12 + name)
            if owner and self.notes:
                out.texts.append(("DebugInfo", owner, "utf-8", at + 12))
            if self.build_id and owner == "GNU" and kind == BUILD_ID and size:
                out.texts.append(("DebugInfo", r.data[body : body + size].hex(), "ascii", body))
            at = body + (size + 3 & ~3)

    def _dynamic(self, r, table, names, wide: bool, out) -> None:
        step = 16 if wide else 8
        for at in range(table[4], table[4] + table[5] - step + 1, step):
            tag, value = r.get(at, "qQ" if wide else "iI")
            if tag == 0:
                return
            text = r.name(names[4] + value, names[4] + names[5]) if tag in DYNAMIC_TEXTS else None
            if text:
                out.texts.append(("LoadCommand", text, "utf-8", names[4] + value))

    def _symbols(self, r, table, rows, wide: bool, out) -> None:
        offset, length, link = table[4], table[5], table[6]
        if link >= len(rows):
            raise ParseError("symbols without names")
        names, size = rows[link], 24 if wide else 16
        for i in range(length // size):
            if wide:
                name, info, _, section, value, _ = r.get(offset + i * size, "IBBHQQ")
            else:
                name, value, _, info, _, section = r.get(offset + i * size, "IIIBBH")
            text = r.name(names[4] + name, names[4] + names[5])
            if info >> 4 != GLOBAL or text is None:
                continue
            if section == UNDEFINED:
                if info & 15 == FUNCTION:
                    out.imports.append((text, None, value))
            elif value:
                out.exports.append((text, value, None))
