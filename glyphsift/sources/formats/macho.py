"""Mach-O files: sections, symbols, and the strings of load commands. Fat files give one slice or all."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from .base import ParseError, Parsed, Reader

# Of the public format (fixed values).
THIN = {0xFEEDFACE: (">", False), 0xCEFAEDFE: ("<", False), 0xFEEDFACF: (">", True), 0xCFFAEDFE: ("<", True)}
FAT, FAT_64 = 0xCAFEBABE, 0xCAFEBABF
SEGMENT, SEGMENT_64, SYMBOLS, BUILD_VERSION = 0x1, 0x19, 0x2, 0x32
ARCHITECTURES = {"i386": 7, "x86_64": 0x01000007, "arm": 12, "arm64": 0x0100000C, "ppc": 18, "ppc64": 0x01000012}
PATHS = {0xC: 8, 0xD: 8, 0x80000018: 8, 0x8000001F: 8, 0x8000001C: 8}  # command: where its string's offset stands


@dataclass(frozen=True)
class MachO:
    """``load_commands``: whether these give texts; ``fat``: "first", "all" or the name of an architecture."""

    load_commands: bool = True
    fat: str = "first"
    name: ClassVar[str] = "MachO"

    def __post_init__(self):
        if self.fat not in ("first", "all", *ARCHITECTURES):
            raise ValueError(f"unknown architecture {self.fat}")

    def detect(self, data: bytes) -> bool:
        magic = int.from_bytes(data[:4], "big")
        # Java classes share the fat magic; their version stands where the number of slices would
        return len(data) >= 28 and (magic in THIN or magic == FAT_64 or (magic == FAT and 0 < int.from_bytes(data[4:8], "big") < 40))

    def slices(self, data: bytes) -> list[tuple[int, int]]:
        """(offset, size) of each architecture; a thin file is one."""
        return [x[1:] for x in self._table(data)]

    def chosen(self, data: bytes) -> list[int]:
        """Which architectures ``fat`` asks for; a thin file is always read, a fat one without the named one never."""
        table = self._table(data)
        if self.fat == "all":
            return list(range(len(table)))
        if self.fat == "first" or table[0][0] is None:
            return [0]
        return [i for i, (cpu, _, _) in enumerate(table) if cpu == ARCHITECTURES[self.fat]]

    def _table(self, data: bytes) -> list[tuple]:
        """(CPU type, offset, size) of each architecture; a thin file has no CPU type here."""
        magic = int.from_bytes(data[:4], "big")
        if magic in THIN:
            return [(None, 0, len(data))]
        r, out = Reader(data, ">"), []
        for i in range(r.get(4, "I")[0]):
            at = 8 + (32 if magic == FAT_64 else 20) * i
            out.append((*r.get(at, "I"), *r.get(at + 8, "QQ" if magic == FAT_64 else "II")))
        if not out:
            raise ParseError("no architecture")
        return out

    def parse(self, data: bytes, which: int = 0):
        if not self.detect(data):
            raise ParseError("not a Mach-O header")
        offset, size = self.slices(data)[which]
        if offset + size > len(data):
            raise ParseError("the architecture ends outside the file")
        out = self._thin(data[offset : offset + size])
        out.arch_offset = offset
        return out

    def _thin(self, data: bytes):
        magic = int.from_bytes(data[:4], "big")
        if magic not in THIN:
            raise ParseError("not a Mach-O header")
        order, wide = THIN[magic]
        r, out = Reader(data, order), Parsed()
        commands = r.get(16, "I")[0]
        at, index = 32 if wide else 28, 0
        for _ in range(commands):
            command, size = r.get(at, "II")
            if size < 8 or at + size > len(data):
                raise ParseError("a load command ends outside the file")
            if command in (SEGMENT, SEGMENT_64):
                index = self._sections(r, at, command == SEGMENT_64, index, out)
            elif command == SYMBOLS:
                self._symbols(r, at, wide, out)
            elif not self.load_commands:
                pass
            elif command in PATHS:
                place = at + r.get(at + PATHS[command], "I")[0]
                text = r.name(place, at + size)
                if text:
                    out.texts.append(("LoadCommand", text, "utf-8", place))
            elif command == BUILD_VERSION:
                x = r.get(at + 12, "I")[0]
                out.texts.append(("LoadCommand", f"{x >> 16}.{x >> 8 & 255}.{x & 255}", "ascii", at + 12))
            at += size
        return out

    def _sections(self, r, at: int, wide: bool, index: int, out) -> int:
        count = r.get(at + (64 if wide else 48), "I")[0]
        first, step = at + (72 if wide else 56), 80 if wide else 68
        for i in range(count):
            place = first + step * i
            section, segment = (x.split(b"\0")[0].decode("utf-8", "replace") or "unknown" for x in r.get(place, "16s16s"))
            address, size, offset = r.get(place + 32, "QQI" if wide else "III")
            flags = r.get(place + (64 if wide else 56), "I")[0]
            if size:
                empty = flags & 0xFF in (1, 12)  # zero-filled: no bytes in the file
                if not empty and offset + size > len(r.data):
                    raise ParseError("a section ends outside the file")
                out.sections.append((index, f"{segment},{section}", segment, flags, offset, 0 if empty else size, size, address, (segment, section) == ("__TEXT", "__text"), segment in ("__DATA", "__DATA_DIRTY")))
            index += 1
        return index

    def _symbols(self, r, at: int, wide: bool, out) -> None:
        table, count, names, size = r.get(at + 8, "IIII")
        for i in range(count):
            name, _, section, _, value = r.get(table + i * (16 if wide else 12), "IBBHQ" if wide else "IBBHI")
            text = r.name(names + name, names + size)
            if text is None:
                continue
            if is_undefined(section, value):
                out.imports.append((text, None, value))
            elif section and value and is_meaningful(text):
                out.exports.append((text, value, None))


def is_undefined(section: int, value: int) -> bool:
    return section == 0 and value == 0


def is_meaningful(name: str) -> bool:
    return name != "_"
