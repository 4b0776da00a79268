"""Command line: strings of files, ranked. ``python -m glyphsift.cli FILE...``"""

from __future__ import annotations

import argparse
import sys
import time

# Exit codes (fixed values).
OK, GENERAL, USAGE, NOT_FOUND, UNSUPPORTED = 0, 1, 2, 3, 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphsift", description="Find, classify and rank the strings of executables.")
    p.add_argument("files", nargs="+")
    p.add_argument("--format", choices=("human", "json", "csv", "yara", "markdown", "xml"))
    p.add_argument("--json", dest="format", action="store_const", const="json")
    p.add_argument("--yara", dest="format", action="store_const", const="yara")
    p.add_argument("--output")
    p.add_argument("--min-len", type=int)
    p.add_argument("--max-len", type=int)
    p.add_argument("--enc", help="encodings, joined by commas")
    p.add_argument("--only", help="tags, joined by commas")
    p.add_argument("--exclude", help="tags, joined by commas")
    p.add_argument("--sections", help="section names, joined by semicolons")
    p.add_argument("--top", type=int)
    p.add_argument("--all", action="store_true")
    p.add_argument("--min-score", type=int)
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--no-rank", action="store_true")
    p.add_argument("--no-classify", action="store_true")
    p.add_argument("--no-symbols", action="store_true")
    p.add_argument("--debug", action=argparse.BooleanOptionalAction)
    p.add_argument("--macho-fat", action="store_true", help="all architectures")
    p.add_argument("--elf-notes", action="store_true", help="owners and build ids of notes")
    p.add_argument("--elf-dynamic", action="store_true", help="libraries and search paths of the dynamic section")
    p.add_argument("--elf-symtab", action="store_true", help="static symbols too")
    p.add_argument("--timing", action="store_true", help="seconds of each step, to the error output")
    p.add_argument("--list-sections", action="store_true")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--config")
    p.add_argument("--profile")
    return p


def configured(args):
    from glyphsift.sources.config import load, merged

    def split(x, by=","):
        return tuple(filter(None, x.split(by))) if x else None

    extraction = {"min_length": args.min_len, "max_length": args.max_len, "encodings": split(args.enc), "include_symbols": False if args.no_symbols else None, "include_debug": args.debug}
    output = {"format": args.format, "max_results": args.top, "only": split(args.only), "exclude": split(args.exclude), "sections": split(args.sections, ";"), "min_score": args.min_score, "dedup": False if args.no_dedup else None, "rank": False if args.no_rank else None, "classify": False if args.no_classify else None}
    config = load(args.config, args.profile)
    config = merged(config, {"extraction": {k: v for k, v in extraction.items() if v is not None}, "output": {k: v for k, v in output.items() if v is not None}})
    if args.all:
        config = merged(config, {"output": {"max_results": None}})
    elf = {"notes": args.elf_notes, "build_id": args.elf_notes, "dynamic": args.elf_dynamic, "symtab": args.elf_symtab}
    if any(elf.values()):
        config = merged(config, {"formats": {"elf": {k: True for k, on in elf.items() if on}}})
    return merged(config, {"all_architectures": True}) if args.macho_fat else config


class Timing:
    """Seconds of each step, on the error output if ``shown``.

    Spark runs extraction, classification and ranking as one job, so these are one step here; its interface has
    the seconds of each operator.
    """

    def __init__(self, shown: bool):
        self.shown, self.at = shown, time.perf_counter()

    def step(self, name: str) -> None:
        now = time.perf_counter()
        if self.shown:
            print(f"{name}: {now - self.at:.3f} s", file=sys.stderr)
        self.at = now


def main(arguments: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(arguments)
        config = configured(args)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return USAGE
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from glyphsift.operators import aggregate
    from glyphsift.plans import pipeline, sinks
    from glyphsift.sources import binaries

    for warning in config.warnings:
        print(f"warning: {warning}", file=sys.stderr)
    timing = Timing(args.timing)
    spark = spark or SparkSession.builder.appName("glyphsift").getOrCreate()
    try:
        files = binaries.read_files(spark, *args.files)
        files.schema  # noqa: B018
        timing.step("session and files")
    except AnalysisException as e:
        print(e, file=sys.stderr)
        return NOT_FOUND
    if args.list_sections:
        binaries.sections(binaries.parse(files, config.all_architectures, config.formats)).orderBy("path", "section_idx").show(1000, False)
        return OK
    found = pipeline.analyse(files, config)
    timing.step("planning")
    if args.summary:
        aggregate.summary(found).show()
        timing.step("extraction, classification, ranking and output")
        return OK
    if args.output:
        sinks.write(found, config.output.format, args.output)
        timing.step("extraction, classification, ranking and output")
        return OK
    lines = sinks.FORMATTERS[config.output.format](found)
    for row in lines.select("value").toLocalIterator():
        print(row["value"])
    timing.step("extraction, classification, ranking and output")
    known = not binaries.parse(files).where("format <> 'Unknown'").isEmpty()
    timing.step("format detection")
    return OK if known else UNSUPPORTED


if __name__ == "__main__":
    sys.exit(main())
