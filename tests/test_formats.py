import pytest
from glyphsift.sources.specimens import elf64, fat, macho64, pe64

from glyphsift.sources import binaries, formats
from glyphsift.sources.formats import macho


def elf():
    return elf64(
        [(".text", 6, b"\x90" * 16, 1), (".rodata", 2, b"https://api.example.com/v1\0hello world\0", 1), (".data", 3, b"value\0", 1), (".bss", 3, bytes(32), 8), (".comment", 0, b"compiled\0", 1)],
        [("printf", 1, 2, 0, 0), ("weak", 2, 2, 0, 0), ("main", 1, 2, 1, 0x401000), ("zero", 1, 2, 1, 0), ("data_object", 1, 1, 3, 0x402000)],
    )


@pytest.mark.parametrize("data", [b"UNKNOWN_FORMAT_DATA", b"NOT_ELF_DATA", b"NOT_PE_DATA", b"NOT_MACHO_DATA", b"", b"MZ", b"\x7fELF"])
def test_garbage_is_unknown(data):
    assert formats.detect(data) == "Unknown"


def test_factory():
    assert [formats.parser_for(n).name for n in ("Elf", "Pe", "MachO")] == ["Elf", "Pe", "MachO"]
    with pytest.raises(formats.ParseError):
        formats.parser_for("Unknown")


def test_elf():
    got = formats.parser_for("Elf").parse(elf())
    by = {s[1]: s for s in got.sections}
    assert set(by) == {".text", ".rodata", ".data", ".bss", ".comment", ".dynsym", ".dynstr", ".shstrtab"}
    assert by[".text"][8] and not by[".text"][9] and by[".data"][9]
    assert by[".bss"][5] == 0 and by[".bss"][6] == 32  # no bytes in the file
    assert [i[0] for i in got.imports] == ["printf"]
    assert [e[0] for e in got.exports] == ["main", "data_object"]


def test_elf_bad_bounds():
    data = bytearray(elf())
    with pytest.raises(formats.ParseError):
        formats.parser_for("Elf").parse(bytes(data[: len(data) - 64]))


def test_pe():
    data = pe64([(".text", 0x60000020, b"\x90" * 16), (".rdata", 0x40000040, b"text\0"), (".data", 0xC0000040, b"x" * 8), (".none", 0x40000040, b"")], [("kernel32.dll", ["CreateFileA", "ReadFile"])], ["first", None])
    got = formats.parser_for("Pe").parse(data)
    assert [s[1] for s in got.sections] == [".text", ".rdata", ".data", ".idata", ".edata"]
    assert [(i[0], i[1]) for i in got.imports] == [("CreateFileA", "kernel32.dll"), ("ReadFile", "kernel32.dll")]
    assert [(e[0], e[2]) for e in got.exports] == [("first", 0), ("ordinal_1", 1)]
    assert formats.detect(data) == "Pe"


def thin():
    return macho64([("__TEXT", "__text", b"\x90" * 8), ("__TEXT", "__cstring", b"hello mach\0"), ("__DATA", "__data", b"data")], [("_puts", 0, 0), ("_main", 1, 0x1000), ("_", 1, 0x2000)], ["/usr/lib/libSystem.B.dylib"])


def test_macho():
    got = formats.parser_for("MachO").parse(thin())
    assert [s[1] for s in got.sections] == ["__TEXT,__text", "__TEXT,__cstring", "__DATA,__data"]
    assert [s[8] for s in got.sections] == [True, False, False] and [s[9] for s in got.sections] == [False, False, True]
    assert [i[0] for i in got.imports] == ["_puts"] and [e[0] for e in got.exports] == ["_main"]
    assert got.texts[0][1] == "/usr/lib/libSystem.B.dylib"


def test_fat():
    data = fat(thin(), thin())
    got = formats.parser_for("MachO").parse(data)
    assert got.arch_offset == 48 and data[got.arch_offset + got.sections[1][4] :].startswith(b"hello mach")
    assert formats.detect(data) == "MachO" and formats.detect(data[:100]) == "Unknown"


def test_macho_helpers():
    assert macho.is_undefined(0, 0) and not macho.is_undefined(1, 0x1000)
    assert all(map(macho.is_meaningful, ("main", "_start", "function_name", ""))) and not macho.is_meaningful("_")


def test_files_as_rows(spark):
    high = elf64([(".rodata", 2, b"abcdef\0", 1)], high=0xFFFFFFFF80000000)
    files = spark.createDataFrame([("a", elf()), ("h", high), ("m", fat(thin())), ("bad", b"nothing"), ("empty", b""), ("null", None)], "path string, content binary")
    parsed = binaries.parse(files)
    formats_ = {r["path"]: (r["format"], r["parse_error"]) for r in binaries.containers(parsed).collect()}
    assert formats_["a"] == ("Elf", None) and formats_["m"] == ("MachO", None)
    assert all(formats_[p] == ("Unknown", "Unsupported file format") for p in ("bad", "empty", "null"))
    kinds = {(r["path"], r["name"]): r for r in binaries.sections(parsed).collect()}
    assert kinds["a", ".rodata"]["section_type"] == "StringData" and kinds["a", ".text"]["section_type"] == "Code"
    assert int(kinds["h", ".rodata"]["rva"]) > 1 << 63
    assert {r["name"] for r in binaries.imports(parsed).collect()} == {"printf", "_puts"}
    assert {r["name"] for r in binaries.exports(parsed).collect()} == {"main", "data_object", "_main"}


def test_all_architectures(spark):
    files = spark.createDataFrame([("m", fat(thin(), thin()))], "path string, content binary")
    assert binaries.parse(files, all_architectures=True).count() == 2
