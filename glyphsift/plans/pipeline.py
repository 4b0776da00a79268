"""The whole dataflow: files or text columns to ranked strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsift import schemas
from glyphsift.functions import classify, rank
from glyphsift.functions.demangle import demangle
from glyphsift.operators import dedup, extract, select
from glyphsift.sources import binaries
from glyphsift.sources.config import Config


def strings_of_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Raw strings of executables: sections, symbols, resources and load commands.

    The content never moves: one pass cuts and scans sections where the file is read, another reads names.
    """
    how = config.extraction
    sections = extract.wanted_sections(binaries.section_bytes(files, config.all_architectures, config.formats), how)
    found = extract.bounded(extract.scan(sections, how), how).withColumn("rva", F.col("base_rva") + (F.col("offset") - F.col("base_offset")).cast("decimal(20,0)")).drop("base_offset")
    if not how.include_symbols and not how.include_resources:
        return found
    names = binaries.named_texts(binaries.parse(files, config.all_architectures, config.formats), how.include_symbols, how.include_resources)
    if config.output.demangle:
        names = names.withColumn("name", demangle(F.col("name")))
    return found.unionByName(extract.named_strings(names))


def strings_of_texts(sections: DataFrame, config: Config = Config()) -> DataFrame:
    """Raw strings of text containers (see ``extract.text_container``)."""
    how = config.extraction
    found = extract.bounded(extract.scan(extract.wanted_sections(sections, how), how), how)
    return found.withColumn("rva", F.col("base_rva")).drop("base_offset")


def tagged(strings: DataFrame, config: Config = Config(), classifiers=()) -> DataFrame:
    tags = classify.tags(F.col("text"), F.col("section_type"), F.col("source"), config.detect, classifiers)
    out = strings.withColumn("tags", tags)
    if not config.skip_low_confidence:
        return out
    sure = classify.confident(classify.results(F.col("text"), F.col("tags"), F.col("section_type")))
    return out.withColumn("tags", F.transform(sure, lambda r: r["tag"]))


def scored(strings: DataFrame, config: Config = Config()) -> DataFrame:
    c = F.col
    return strings.withColumn("score", rank.score(c("text"), c("encoding"), c("section"), c("section_type"), c("format"), c("source"), c("tags"), c("length"), c("printable"), c("entropy"), c("top_share"), config.ranking))


def found_strings(raw: DataFrame, config: Config = Config(), classifiers=()) -> DataFrame:
    """Deduplicated, tagged and scored strings, filtered as asked; order and limit are ``select.top``'s."""
    out = config.output
    # equal strings are joined first, so tags and scores are computed once for each
    strings = dedup.first_of_each(raw) if out.dedup else raw
    strings = tagged(strings, config, classifiers) if out.classify else strings.withColumn("tags", F.array().cast("array<string>"))
    strings = scored(strings, config) if out.rank else strings.withColumn("score", F.lit(0))
    if out.only:
        strings = select.only(strings, *out.only)
    if out.exclude:
        strings = select.exclude(strings, *out.exclude)
    if out.sections:
        strings = select.in_sections(strings, *out.sections)
    return select.min_score(strings, out.min_score) if out.min_score else strings


def public(strings: DataFrame) -> DataFrame:
    """``path`` and the nine public fields."""
    return strings.select("path", *schemas.FOUND)


def analyse(files: DataFrame, config: Config = Config(), classifiers=()) -> DataFrame:
    """The best strings of each file in order."""
    found = found_strings(strings_of_files(files, config), config, classifiers)
    n = config.output.max_results
    if n is not None:
        found = select.top_each(found, n)
    ordered = found.orderBy("path", *select.rank_order()) if config.output.rank else found.orderBy("path", "offset")
    return public(ordered)
