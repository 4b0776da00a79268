"""Named queries over executables that are made here byte by byte, each with its expected rows as SQL.

The expected rows are written out from how the files are put together, not from what the parsers say.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.sources import binaries
from glyphsift.sources.specimens import elf64, fat, macho64, pe64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CODE = b"\xc3"
#: Sections of every kind, an empty one, and symbols on either side of each condition.
ELF = elf64(
    [(".text", 6, CODE * 24, 1), (".rodata", 2, b"first line\0second line\0", 1), (".data", 3, b"counter\0", 1), (".bss", 3, bytes(48), 8), (".empty", 2, b"", 1), (".note", 2, b"n" * 9, 7)],
    [("open_door", 1, 2, 0, 0), ("weak_door", 2, 2, 0, 0), ("door_count", 1, 1, 0, 0), ("untyped", 1, 0, 0, 0), ("run", 1, 2, 1, 0x401000), ("local_run", 0, 2, 1, 0x401008), ("at_zero", 1, 2, 1, 0), ("total", 1, 1, 3, 0x402000)],
)
PE = pe64(
    [(".text", 0x60000020, CODE * 32), (".rdata", 0x40000040, b"read only text\0"), (".data", 0xC0000040, b"y" * 12), (".gone", 0x40000040, b"")],
    [("first.dll", ["OpenDoor", "CloseDoor"]), ("second.dll", ["Ring"])],
    ["Start", None, "Stop"],
)
MACHO = macho64(
    [("__TEXT", "__text", CODE * 12), ("__TEXT", "__cstring", b"apple text\0"), ("__DATA", "__data", b"abcd"), ("__DATA_CONST", "__const", b"efgh"), ("__DATA", "__none", b"")],
    [("_open_door", 0, 0), ("_run", 1, 0x1000), ("_", 1, 0x2000), ("", 1, 0x3000), ("_at_zero", 2, 0)],
    ["/usr/lib/libDoor.dylib"],
)
#: Names stand in .dynstr in the order of the symbols, after a NUL: libdoor.so at 1, /opt/doors at 12, hidden at 23.
NOTE = struct.pack("<III", 4, 4, 3) + b"GNU\0" + b"\xde\xad\xbe\xef" + struct.pack("<III", 5, 2, 9) + b"Door\0\0\0\0" + b"xy\0\0"
EXTRA = elf64(
    [(".note.id", 2, NOTE, 7), (".dynamic", 3, struct.pack("<qQqQqQqQqQ", 1, 1, 5, 0, 29, 12, 0, 0, 1, 12), 6), (".symtab", 0, struct.pack("<IBBHQQ", 23, 18, 0, 1, 0x5000, 0), 2)],
    [("libdoor.so", 0, 0, 0, 0), ("/opt/doors", 0, 0, 0, 0), ("hidden", 0, 0, 0, 0)],
)
TWO_CPUS = fat(MACHO, macho64([("__TEXT", "__cstring", b"other\0")], [], []), cpus=(0x0100000C, 0x01000007))
FILES = (("extra", EXTRA), ("two", TWO_CPUS), ("elf", ELF), ("pe", PE), ("macho", MACHO), ("fat", fat(MACHO, MACHO)), ("cut", ELF[:-64]), ("head", b"\x7fELF"), ("text", b"plain text"), ("none", b""))


def files(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(b)) for n, b in FILES if n in names or not names], "path string, content binary")


def query(name: str, columns: str, *rows: tuple):
    """Registers a query; its SQL is the rows that are expected, with whole numbers as BIGINT."""

    def said(x) -> str:
        if x is None or isinstance(x, bool):
            return {None: "NULL", True: "true", False: "false"}[x]
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)"

    def put(f):
        QUERIES[name] = f
        ORACLE[name] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") v({columns})"
        return f

    return put


def section_rows(spark: SparkSession, *names: str) -> DataFrame:
    each = binaries.sections(binaries.parse(files(spark, *names)))
    return each.select("path", F.col("section_idx").cast("long").alias("idx"), "name", "section_type", "offset", "size", "file_size", F.col("rva").cast("long").alias("rva"), "is_executable", "is_writable").withColumnRenamed("offset", "place")


SECTION = "path, idx, name, section_type, place, size, file_size, rva, is_executable, is_writable"


@query("con_1_detect", "path, format", ("extra", "Elf"), ("two", "MachO"), ("elf", "Elf"), ("pe", "Pe"), ("macho", "MachO"), ("fat", "MachO"), ("cut", "Unknown"), ("head", "Unknown"), ("text", "Unknown"), ("none", "Unknown"))
def con_1(spark, d):
    return binaries.containers(binaries.parse(files(spark))).select("path", "format")


@query("con_5_elf_sections", SECTION,
    ("elf", 1, ".text", "Code", 64, 24, 24, 0x400040, True, False),
    ("elf", 2, ".rodata", "StringData", 88, 23, 23, 0x400058, False, False),
    ("elf", 3, ".data", "WritableData", 111, 8, 8, 0x40006F, False, True),
    ("elf", 4, ".bss", "WritableData", 119, 48, 0, 0x400077, False, True),
    ("elf", 6, ".note", "StringData", 119, 9, 9, 0x400077, False, False),
    ("elf", 7, ".dynsym", "Debug", 128, 9 * 24, 9 * 24, 0x400080, False, False),
    ("elf", 8, ".dynstr", "Debug", 344, 68, 68, 0x400158, False, False),
    ("elf", 9, ".shstrtab", "Debug", 412, 65, 65, 0, False, False),
)
def con_5(spark, d):
    return section_rows(spark, "elf")


@query("con_7_elf_imports", "name, library, address", ("open_door", None, 0))
def con_7(spark, d):
    return binaries.imports(binaries.parse(files(spark, "elf"))).select("name", "library", F.col("address").cast("long").alias("address"))


@query("con_8_elf_exports", "name, address", ("run", 0x401000), ("total", 0x402000))
def con_8(spark, d):
    return binaries.exports(binaries.parse(files(spark, "elf"))).select("name", F.col("address").cast("long").alias("address"))


@query("con_9_pe_sections", SECTION,
    ("pe", 0, ".text", "Code", 1024, 32, 32, 0x1000, True, False),
    ("pe", 1, ".rdata", "StringData", 1056, 15, 15, 0x2000, False, False),
    ("pe", 2, ".data", "WritableData", 1071, 12, 12, 0x3000, False, True),
    ("pe", 4, ".idata", "Other", 1083, 151, 151, 0x5000, False, False),
    ("pe", 5, ".edata", "Other", 1234, 75, 75, 0x6000, False, False),
)
def con_9(spark, d):
    return section_rows(spark, "pe")


@query("con_11_pe_imports", "name, library", ("OpenDoor", "first.dll"), ("CloseDoor", "first.dll"), ("Ring", "second.dll"))
def con_11(spark, d):
    return binaries.imports(binaries.parse(files(spark, "pe"))).select("name", "library")


@query("con_12_pe_exports", "name, address, ordinal", ("Start", 0x1000, 0), ("ordinal_1", 0x1010, 1), ("Stop", 0x1020, 2))
def con_12(spark, d):
    return binaries.exports(binaries.parse(files(spark, "pe"))).select("name", F.col("address").cast("long").alias("address"), F.col("ordinal").cast("long").alias("ordinal"))


def _macho_sections(path: str) -> tuple:
    return (
        (path, 0, "__TEXT,__text", "Code", 863, 12, 12, 0x1000 + 863, True, False),
        (path, 1, "__TEXT,__cstring", "StringData", 875, 11, 11, 0x1000 + 875, False, False),
        (path, 2, "__DATA,__data", "WritableData", 886, 4, 4, 0x1000 + 886, False, True),
        (path, 3, "__DATA_CONST,__const", "ReadOnlyData", 890, 4, 4, 0x1000 + 890, False, False),
    )


@query("con_13_macho_sections", SECTION, *_macho_sections("macho"))
def con_13(spark, d):
    return section_rows(spark, "macho")


@query("con_15_macho_imports", "name, library, address", ("_open_door", None, 0))
def con_15(spark, d):
    return binaries.imports(binaries.parse(files(spark, "macho"))).select("name", "library", F.col("address").cast("long").alias("address"))


@query("con_16_macho_exports", "name, address", ("_run", 0x1000), ("", 0x3000))
def con_16(spark, d):
    return binaries.exports(binaries.parse(files(spark, "macho"))).select("name", F.col("address").cast("long").alias("address"))


@query("con_17_fat_slice", f"{SECTION}, arch_offset", *((*r, 48) for r in _macho_sections("fat")))
def con_17(spark, d):
    """The first architecture; offsets count from its slice, which begins at ``arch_offset``."""
    where = binaries.parse(files(spark, "fat")).select("path", "arch_offset")
    return section_rows(spark, "fat").join(where, "path").withColumn("arch_offset", F.col("arch_offset").cast("long"))


@query("con_18_fat_all", "arch_offset, n_sections", (48, 4), (48 + 1003, 4))
def con_18(spark, d):
    every = binaries.sections(binaries.parse(files(spark, "fat"), all_architectures=True))
    return every.groupBy(F.col("arch_offset").cast("long").alias("arch_offset")).agg(F.count("*").alias("n_sections"))


@query("con_18_fat_named", "path, section", ("two", "__TEXT,__cstring"), *(("macho", r[2]) for r in _macho_sections("macho")))
def con_18_named(spark, d):
    """One architecture by name: a fat file without it has no sections, a thin file is read whatever it is."""
    chosen = binaries.sections(binaries.parse(files(spark, "two", "fat", "macho"), switches={"macho": {"fat": "x86_64"}}))
    return chosen.select("path", F.col("name").alias("section"))


@query("con_21_elf_notes", "source, text", ("DebugInfo", "GNU"), ("DebugInfo", "deadbeef"), ("DebugInfo", "Door"), ("LoadCommand", "libdoor.so"), ("LoadCommand", "/opt/doors"))
def con_21(spark, d):
    """Notes and dynamic strings, up to the dynamic section's end mark."""
    parsed = binaries.parse(files(spark, "extra"), switches={"elf": {"notes": True, "build_id": True, "dynamic": True}})
    return binaries.named_texts(parsed, symbols=False).select("source", F.col("name").alias("text"))


@query("con_23_elf_symtab", "name, address", ("hidden", 0x5000))
def con_23(spark, d):
    return binaries.exports(binaries.parse(files(spark, "extra"), switches={"elf": {"symtab": True}})).select("name", F.col("address").cast("long").alias("address"))


@query("cfg_4_format_switches", "path, n_texts", ("macho", 0), ("extra", 0))
def cfg_4(spark, d):
    """Without load commands Mach-O files give no texts; ELF files give theirs only on request."""
    parsed = binaries.parse(files(spark, "macho", "extra"), switches={"macho": {"load_commands": False}})
    return parsed.select("path", F.size("texts").cast("long").alias("n_texts"))


@query("con_20_load_commands", "path, text", ("macho", "/usr/lib/libDoor.dylib"), ("fat", "/usr/lib/libDoor.dylib"))
def con_20(spark, d):
    rows = binaries.named_texts(binaries.parse(files(spark, "macho", "fat", "elf", "pe", "extra")), symbols=False)
    return rows.where("source = 'LoadCommand'").select("path", F.col("name").alias("text"))


@query("ext_11_symbols", "path, source, name",
    ("elf", "ImportName", "open_door"), ("elf", "ExportName", "run"), ("elf", "ExportName", "total"),
    ("pe", "ImportName", "OpenDoor"), ("pe", "ImportName", "CloseDoor"), ("pe", "ImportName", "Ring"),
    ("pe", "ExportName", "Start"), ("pe", "ExportName", "ordinal_1"), ("pe", "ExportName", "Stop"),
)
def ext_11(spark, d):
    return binaries.named_texts(binaries.parse(files(spark, "elf", "pe")), resources=False).select("path", "source", "name")


@query("src_4_section_bytes", "path, section, body",
    ("elf", ".rodata", "first line|second line|"), ("elf", ".note", "nnnnnnnnn"),
    ("pe", ".rdata", "read only text|"), ("macho", "__TEXT,__cstring", "apple text|"), ("fat", "__TEXT,__cstring", "apple text|"),
)
def src_4(spark, d):
    cut = binaries.section_bytes(files(spark, "elf", "pe", "macho", "fat", "cut", "text", "none")).where("section_type = 'StringData'")
    return cut.select("path", "section", F.translate(F.col("content").cast("string"), "\x00", "|").alias("body"))
