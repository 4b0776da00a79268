"""Schemas and closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed vocabularies, in their documented order.
ENCODINGS = ("ascii", "utf-8", "utf-16le", "utf-16be")
TAGS = ("url", "domain", "ipv4", "ipv6", "filepath", "regpath", "guid", "email", "b64", "fmt", "user-agent-ish", "import", "export", "version", "manifest", "resource")
SECTION_TYPES = ("StringData", "ReadOnlyData", "WritableData", "Code", "Debug", "Resources", "Other")
SOURCES = ("SectionData", "ImportName", "ExportName", "ResourceString", "LoadCommand", "DebugInfo")
FORMATS = ("Elf", "Pe", "MachO", "Unknown")

#: Unsigned 64-bit addresses don't fit a long.
ADDRESS = T.DecimalType(20, 0)

BINARIES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

SECTION = "struct<section_idx:int,name:string,segment:string,flags:bigint,offset:bigint,size:bigint,memory_size:bigint,rva:decimal(20,0),is_executable:boolean,is_writable:boolean>"
IMPORT = "struct<name:string,library:string,address:decimal(20,0)>"
EXPORT = "struct<name:string,address:decimal(20,0),ordinal:int>"
TEXT = "struct<kind:string,text:string,encoding:string,offset:bigint>"
PARSED = f"path string, format string, parse_error string, arch_offset bigint, sections array<{SECTION}>, imports array<{IMPORT}>, exports array<{EXPORT}>, texts array<{TEXT}>"

#: What a scan yields for each string; ``entropy`` and ``top_share`` are of its characters.
RAW = "text string, encoding string, offset bigint, length bigint, printable double, entropy double, top_share double"

#: The nine public fields of a found string, in order.
FOUND = ("text", "encoding", "offset", "rva", "section", "length", "tags", "score", "source")
