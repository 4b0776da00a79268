"""Strings out of byte buffers, with exact byte offsets.

The scan runs over Arrow batches: one pass finds the runs of every wanted encoding, and counts characters
for the score while the bytes are at hand. It needs no shuffle, unlike summing piece lengths in a window.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift import schemas

#: Section-specific least lengths (fixed values).
SECTION_MINIMUMS = {".rodata": 3, ".rdata": 4, "__cstring": 3, "__TEXT,__cstring": 3, ".data.rel.ro": 5}
WRITABLE_MINIMUM = 6
ALIASES = {"a": "ascii", "u8": "utf-8", "u16": "utf-16", "u16le": "utf-16le", "u16be": "utf-16be"}


@dataclass(frozen=True)
class Extraction:
    """What is extracted. A string over ``max_length`` is left out."""

    min_length: int = 4
    min_wide_length: int = 3
    max_length: int = 1024
    encodings: tuple[str, ...] = ("ascii", "utf-16le")
    include_sections: tuple[str, ...] = ()
    exclude_sections: tuple[str, ...] = ()
    include_debug: bool = False
    include_resources: bool = True
    include_symbols: bool = True
    section_minimums: bool = False
    drop_padding: bool = True
    drop_interleaved: bool = True
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        names = []
        for e in self.encodings:
            e = ALIASES.get(e, e)
            names += {"utf-16": ["utf-16le", "utf-16be"], "all": list(schemas.ENCODINGS)}.get(e, [e])
        if unknown := set(names) - set(schemas.ENCODINGS):
            raise ValueError(f"unknown encodings {sorted(unknown)}")
        object.__setattr__(self, "encodings", tuple(dict.fromkeys(names)))
        if self.min_length > self.max_length:
            object.__setattr__(self, "warnings", ("min_length is greater than max_length",))


def text_container(df: DataFrame, key: str, text: str, name: str, section_type: str) -> DataFrame:
    """A text column as sections: path "name/key", the UTF-8 bytes as content. A null text has no bytes."""
    return df.select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"), F.lit("Unknown").alias("format"), F.lit(name).alias("section"), F.lit(section_type).alias("section_type"), F.lit(0).cast("long").alias("base_offset"), F.lit(None).cast("decimal(20,0)").alias("base_rva"), F.lit("SectionData").alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out over the cores where the input has fewer splits than that; larger inputs stay as they are.

    A scan costs far more than moving its input once, but only while moving makes idle cores work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < 2 * cores else df


def wanted_sections(sections: DataFrame, how: Extraction) -> DataFrame:
    """Sections that are scanned; the choice is made before any byte is read.

    A Mach-O section can be named in full or by the part after the comma.
    """
    name = F.col("section")
    short = F.element_at(F.split(name, ","), -1)
    if how.include_sections:
        sections = sections.where(name.isin(*how.include_sections) | short.isin(*how.include_sections))
    if how.exclude_sections:
        sections = sections.where(~(name.isin(*how.exclude_sections) | short.isin(*how.exclude_sections)))
    if not how.include_debug:
        sections = sections.where("section_type <> 'Debug'")
    return sections if how.include_resources else sections.where("section_type <> 'Resources'")


def patterns(how: Extraction) -> list[tuple[str, re.Pattern]]:
    """(encoding, pattern over bytes) of the wanted encodings; lengths are in characters."""
    least, wide = how.min_length, how.min_wide_length
    if how.section_minimums:
        least, wide = min([least, *SECTION_MINIMUMS.values()]), min(wide, 3)
    plain = rb"[\x20-\x7E\t]"
    long_ = rb"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
    made = {
        "ascii": plain + b"{%d,}" % least,
        "utf-8": b"(?:" + plain + b"|" + long_ + b"){%d,}" % least,
        "utf-16le": rb"(?:[\x20-\x7E]\x00){%d,}" % wide,
        "utf-16be": rb"(?:\x00[\x20-\x7E]){%d,}" % wide,
    }
    return [(e, re.compile(made[e])) for e in how.encodings]


def spans(content: bytes, pattern: re.Pattern, wide: bool):
    """(begin, end) of matches; wide ones begin at even offsets, as units are read in steps of two."""
    at = 0
    while m := pattern.search(content, at):
        if wide and m.start() % 2:
            at = m.start() + 1
            continue
        yield m.span()
        at = m.end()


def scan(sections: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """The strings of every section: all columns but ``content``, then schemas.RAW.

    ``offset`` counts from the section's ``base_offset``. Empty and null contents have none. A run that ends
    with the buffer counts. With ``drop_interleaved`` an ASCII run inside a UTF-16 one is left out, with
    ``drop_padding`` a run of one repeated character.
    """
    kinds = patterns(how)
    kept = [f for f in sections.schema.fields if f.name != "content"]
    place = sections.columns.index("content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + schemas.RAW
    most, padding, interleaved = how.max_length, how.drop_padding, how.drop_interleaved
    codecs = {"ascii": "ascii", "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}

    def found(batches):
        for batch in batches:
            row, texts, names, offsets, lengths = [], [], [], [], []
            for i, content in enumerate(batch.column(place).to_pylist()):
                if not content:
                    continue
                wide, begins, reach = [], None, []
                for name, pattern in sorted(kinds, key=lambda k: not k[0].startswith("utf-16")):
                    is_wide = name.startswith("utf-16")
                    if not is_wide and begins is None:
                        wide.sort()
                        begins, reach = [a for a, _ in wide], list(accumulate((z for _, z in wide), max))
                    for a, z in spans(content, pattern, is_wide):
                        if is_wide:
                            wide.append((a, z))
                        elif interleaved and (n := bisect_left(begins, z)) and reach[n - 1] > a:
                            continue  # of the wide runs that begin before z one reaches beyond a
                        text = content[a:z].decode(codecs[name])
                        if len(text) > most or (padding and text.count(text[0]) == len(text)):
                            continue
                        row.append(i)
                        texts.append(text)
                        names.append(name)
                        offsets.append(a)
                        lengths.append(z - a)
            if not row:
                continue
            printable, entropy, top = batch_counts(texts)
            at = pa.array(row, pa.int64())
            others = [c.take(at) for j, c in enumerate(batch.columns) if j != place]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(printable), pa.array(entropy), pa.array(top)], [*[f.name for f in kept], "text", "encoding", "offset", "length", "printable", "entropy", "top_share"])

    out = sections.mapInArrow(found, schema)
    return out.withColumn("offset", F.col("offset") + F.col("base_offset")) if "base_offset" in sections.columns else out


def batch_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character statistics of many texts at once."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    cell, count = np.unique(row * 0x110000 + points, return_counts=True)
    row, point = cell // 0x110000, cell % 0x110000
    share = count / size[row]
    head = np.flatnonzero(np.diff(row, prepend=-1))
    printable = np.add.reduceat(np.where((point >= 32) & (point <= 126), share, 0.0), head)
    return printable, np.add.reduceat(-share * np.log2(share), head), np.maximum.reduceat(share, head)


def bounded(strings: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """Length bounds in characters, by section where ``section_minimums`` is set."""
    size = F.when(F.col("encoding").startswith("utf-16"), F.floor(F.col("length") / 2)).otherwise(F.length("text"))
    least = F.when(F.col("encoding").startswith("utf-16"), how.min_wide_length).otherwise(how.min_length)
    if how.section_minimums:
        least = section_minimum(F.col("section"), F.col("section_type"), least)
    return strings.where((size >= least) & (size <= how.max_length))


def section_minimum(section: Column, section_type: Column, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_MINIMUMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, section), F.when(section_type == "WritableData", WRITABLE_MINIMUM).otherwise(otherwise))


def wide_confidence(printable: Column, terminated: Column, n_chars: Column) -> Column:
    """How sure a UTF-16 string is: high, medium, low or none."""
    return F.when((printable > 0.90) & terminated, "high").when((printable > 0.70) & (n_chars >= 3), "medium").when(printable > 0.50, "low").otherwise("none")


def named_strings(names: DataFrame) -> DataFrame:
    """Names and resource texts (path, format, source, name, address, offset) as strings of no section."""
    text = F.col("name")
    stats = F.pandas_udf(_stats, "printable double, entropy double, top_share double")(text)
    kind = F.when(F.col("source") == "ResourceString", "Resources").otherwise("Other")
    return names.where(text != "").select("path", "format", F.lit(None).cast("string").alias("section"), kind.alias("section_type"), F.lit(None).cast("decimal(20,0)").alias("base_rva"), "source", text.alias("text"), F.when(text.rlike(r"^[\x00-\x7F]*$"), "ascii").otherwise("utf-8").alias("encoding"), "offset", F.octet_length(text).cast("long").alias("length"), stats.alias("s"), F.col("address").alias("rva")).select("*", "s.printable", "s.entropy", "s.top_share").drop("s")


def _stats(texts: pd.Series) -> pd.DataFrame:
    printable, entropy, top = batch_counts(texts.tolist())
    return pd.DataFrame({"printable": printable, "entropy": entropy, "top_share": top})
