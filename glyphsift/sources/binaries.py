"""Files as rows, and what their containers hold."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphsift import schemas
from glyphsift.functions.sections import section_type

from . import formats


def read_files(spark: SparkSession, *paths: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of each file; a file is one row, up to 2 GB."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(list(paths))


def distinct_files(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Files with their content's digest, without those whose digest was ``seen``: for incremental runs."""
    marked = files.withColumn("digest", F.sha2("content", 256))
    return marked if seen is None else marked.join(seen.select("digest").distinct(), "digest", "left_anti")


def _schema():
    return StructType.fromDDL(schemas.PARSED)


def _reader(all_architectures: bool, switches: dict | None):
    """A function of a file's bytes: its format, what is wrong with it, and its parsed architectures."""
    if all_architectures:
        switches = {**(switches or {}), "macho": {**(switches or {}).get("macho", {}), "fat": "all"}}
    parsers, error = formats.switched(switches), formats.ParseError

    def read(data: bytes):
        failed = "Unsupported file format"
        for parser in parsers:
            try:
                if not parser.detect(data):
                    continue
                which = parser.chosen(data) if hasattr(parser, "chosen") else [0]
                return parser.name, None, [parser.parse(data, i) if i else parser.parse(data) for i in which]
            except error as e:
                failed = str(e)
        return "Unknown", failed, []

    return read


def parse(files: DataFrame, all_architectures: bool = False, switches: dict | None = None) -> DataFrame:
    """path, format, parse_error, arch_offset and the arrays sections, imports, exports, texts of each file.

    What isn't one of the formats is Unknown with an error, never a failed job. The parsers run where the
    content is; only their rows leave. ``switches`` are the formats' own (see ``formats.switched``).
    """
    schema = _schema()
    arrow = to_arrow_schema(schema)
    kinds = {f.name: [x.name for x in f.dataType.elementType.fields] for f in schema.fields[4:]}
    read = _reader(all_architectures, switches)

    def each(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, failed, got = read(data or b"")
                rows = [{"path": path, "format": name, "parse_error": failed, "arch_offset": p.arch_offset if p else 0, **{k: [dict(zip(names, x, strict=True)) for x in getattr(p, k)] if p else [] for k, names in kinds.items()}} for p in got or [None]]
                for row in rows:
                    for k, column in (("sections", "rva"), ("imports", "address"), ("exports", "address")):
                        for x in row[k]:
                            x[column] = None if x[column] is None else Decimal(x[column])
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(each, schema)


def section_bytes(files: DataFrame, all_architectures: bool = False, switches: dict | None = None) -> DataFrame:
    """The sections as scan input, each with its own bytes, cut where the file is read: no content is shuffled."""
    read = _reader(all_architectures, switches)
    arrow = pa.schema([("path", pa.string()), ("format", pa.string()), ("section", pa.string()), ("segment", pa.string()), ("flags", pa.int64()), ("base_offset", pa.int64()), ("base_rva", pa.decimal128(20, 0)), ("content", pa.binary())])

    def cut(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, _, got = read(data or b"")
                rows = [(path, name, s[1], s[2], s[3], s[4] + p.arch_offset, Decimal(s[7]), data[s[4] + p.arch_offset : s[4] + p.arch_offset + s[5]]) for p in got for s in p.sections if s[5] > 0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    cuts = files.select("path", "content").mapInArrow(cut, "path string, format string, section string, segment string, flags long, base_offset long, base_rva decimal(20,0), content binary")
    kind = section_type(F.col("format"), F.col("section"), F.col("segment"), F.col("flags"))
    return cuts.select("path", "format", "section", kind.alias("section_type"), "base_offset", "base_rva", F.lit("SectionData").alias("source"), "content")


def containers(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "format", "parse_error")


def sections(parsed: DataFrame) -> DataFrame:
    """One row a section, in the order of the schemas, with ``format``, ``arch_offset`` and ``file_size`` too."""
    each = parsed.select("path", "format", "arch_offset", F.explode("sections").alias("s")).select("path", "format", "arch_offset", "s.*")
    kind = section_type(F.col("format"), F.col("name"), F.col("segment"), F.col("flags"))
    return each.select("path", "section_idx", "name", "offset", F.col("memory_size").alias("size"), "rva", kind.alias("section_type"), "is_executable", "is_writable", "format", "arch_offset", F.col("size").alias("file_size"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*")


def exports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("exports").alias("e")).select("path", "e.*")


def _named(source: str):
    return lambda x: F.struct(F.lit(source), x["name"], x["address"], F.lit(None))


def named_texts(parsed: DataFrame, symbols: bool = True, resources: bool = True) -> DataFrame:
    """(path, format, source, name, address, offset) of imports, exports, resources and load commands, in one pass."""
    kind = "array<struct<source:string,name:string,address:decimal(20,0),offset:bigint>>"
    nothing = F.lit(None)
    parts = []
    if symbols:
        parts += [F.transform(c, _named(s)).cast(kind) for c, s in (("imports", "ImportName"), ("exports", "ExportName"))]
    if resources:
        parts.append(F.transform("texts", lambda x: F.struct(x["kind"], x["text"], nothing, x["offset"] + F.col("arch_offset"))).cast(kind))
    return parsed.select("path", "format", F.explode(F.concat(*parts)).alias("x")).select("path", "format", "x.*")
