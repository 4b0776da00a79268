"""What the parsers share: errors, rows and bounded reads."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

class ParseError(Exception):
    """A file that can't be parsed."""


@dataclass
class Parsed:
    """Rows as tuples in the order of the schemas; ``arch_offset`` is where a slice begins in its file."""

    sections: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    arch_offset: int = 0


class Reader:
    """Bounded reads of packed values."""

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.order = data, order

    def get(self, at: int, kinds: str) -> tuple:
        size = struct.calcsize(self.order + kinds)
        if at < 0 or at + size > len(self.data):
            raise ParseError(f"{size} bytes at {at} are outside the file")
        return struct.unpack_from(self.order + kinds, self.data, at)

    def name(self, at: int, end: int | None = None) -> str | None:
        """A NUL-terminated string, or None outside the buffer."""
        end = len(self.data) if end is None else min(end, len(self.data))
        if not 0 <= at < end:
            return None
        stop = self.data.find(b"\0", at, end)
        return self.data[at : stop if stop >= 0 else end].decode("utf-8", "replace")
