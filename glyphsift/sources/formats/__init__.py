"""Parsers of executable formats: bytes in, plain rows out.

A parser is an object with ``name``, ``detect(data) -> bool`` and ``parse(data) -> Parsed``; ``register`` adds
one. Its switches, if any, are its fields; ``switched`` sets them. Input may be hostile: every table is bounded by the buffer, and what can't be read
raises ParseError, which becomes data.
"""

from __future__ import annotations

from dataclasses import fields, replace
from typing import Protocol

from . import elf, macho, pe
from .base import ParseError, Parsed


class Parser(Protocol):
    name: str

    def detect(self, data: bytes) -> bool: ...

    def parse(self, data: bytes) -> Parsed: ...


REGISTRY: list = []


def register(parser: Parser) -> Parser:
    """Adds a parser; the first that detects a file parses it."""
    REGISTRY.append(parser)
    return parser


def parser_for(name: str) -> Parser:
    for parser in REGISTRY:
        if parser.name == name:
            return parser
    raise ParseError("Unsupported file format")


for _parser in (elf.Elf(), pe.Pe(), macho.MachO()):
    register(_parser)


def switched(switches: dict | None = None) -> list[Parser]:
    """The parsers with their switches set: {"elf": {"notes": True}}; an unknown format or switch is an error."""
    switches = {k.lower(): v for k, v in (switches or {}).items()}
    if unknown := set(switches) - {p.name.lower() for p in REGISTRY}:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    out = []
    for parser in REGISTRY:
        given = switches.get(parser.name.lower(), {})
        if given and (unknown := set(given) - {f.name for f in fields(parser)}):
            raise ValueError(f"unknown settings of {parser.name}: {sorted(unknown)}")
        out.append(replace(parser, **given) if given else parser)
    return out


def detect(data: bytes) -> str:
    """The format of the first parser that reads the whole file, else Unknown; never fails."""
    for parser in REGISTRY:
        try:
            if parser.detect(data):
                parser.parse(data)
                return parser.name
        except ParseError:
            continue
    return "Unknown"
