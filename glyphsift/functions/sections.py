"""What a section holds, from its name and flags, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section names and flag bits by format (fixed values).
ELF_EXECUTE, ELF_WRITE = 0x4, 0x1
PE_CODE, PE_WRITE = 0x20, 0x80000000
ELF_STRINGS = (".rodata", ".rodata.str1.1", ".rodata.str1.4", ".rodata.str1.8", ".comment", ".note", ".note.gnu.build-id")
ELF_TABLES = (".strtab", ".shstrtab", ".symtab", ".dynsym", ".dynstr")
PE_UNWIND = (".debug", ".pdata", ".xdata")
MACHO_CODE = ("__text", "__stubs", "__stub_helper")


def choose(cases: list[tuple[Column, str]], otherwise: str = "Other") -> Column:
    """The label of the first case that holds; a null condition doesn't."""
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(otherwise))


def elf_section_type(name: Column, flags: Column) -> Column:
    return choose([
        (flags.bitwiseAND(ELF_EXECUTE) != 0, "Code"),
        (name.isin(*ELF_STRINGS), "StringData"),
        (name.isin(".data.rel.ro", ".data.rel.ro.local"), "ReadOnlyData"),
        (name.isin(".data", ".bss"), "WritableData"),
        (name.startswith(".debug_") | name.isin(*ELF_TABLES), "Debug"),
    ])


def pe_section_type(name: Column, flags: Column) -> Column:
    writable = flags.bitwiseAND(F.lit(PE_WRITE)) != 0
    return choose([
        (flags.bitwiseAND(F.lit(PE_CODE)) != 0, "Code"),
        (name.isin(".rdata", ".rodata"), "StringData"),
        ((name == ".data") & ~writable, "ReadOnlyData"),
        (name.isin(".data", ".bss"), "WritableData"),
        (name == ".rsrc", "Resources"),
        (name.isin(*PE_UNWIND) | name.startswith(".debug"), "Debug"),
    ])


def macho_section_type(segment: Column, section: Column) -> Column:
    return choose([
        ((segment == "__TEXT") & section.isin("__cstring", "__const"), "StringData"),
        ((segment == "__DATA_CONST") & (section == "__cfstring"), "StringData"),
        (segment == "__DATA_CONST", "ReadOnlyData"),
        (segment == "__DATA", "WritableData"),
        ((segment == "__TEXT") & section.isin(*MACHO_CODE), "Code"),
        (segment == "__DWARF", "Debug"),
        (section.startswith("__debug"), "Debug"),
    ])


def macho_executable(segment: Column, section: Column) -> Column:
    return (segment == "__TEXT") & (section == "__text")


def macho_writable(segment: Column) -> Column:
    return segment.isin("__DATA", "__DATA_DIRTY")


def section_type(format: Column, name: Column, segment: Column, flags: Column) -> Column:
    """By format; Mach-O names are "segment,section"."""
    section = F.element_at(F.split(name, ","), -1)
    return F.when(format == "Elf", elf_section_type(name, flags)).when(format == "Pe", pe_section_type(name, flags)).when(format == "MachO", macho_section_type(segment, section)).otherwise("Other")
