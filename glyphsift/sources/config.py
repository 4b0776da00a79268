"""Configuration: built-in profiles, a TOML file, environment variables, in rising order."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from glyphsift.functions.classify import Detect
from glyphsift.functions.rank import BOOSTS, SECTION_WEIGHTS, Ranking
from glyphsift.operators.extract import Extraction

from .formats import switched

#: Environment variables read as overrides begin so.
PREFIX = "GLYPHSIFT_"


@dataclass(frozen=True)
class Output:
    """What is returned and how it is shown."""

    format: str = "human"
    max_results: int | None = 100
    min_score: int = 0
    only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    truncate: int = 80
    color: bool = False
    dedup: bool = True
    classify: bool = True
    rank: bool = True
    demangle: bool = True


@dataclass(frozen=True)
class Config:
    extraction: Extraction = Extraction()
    detect: Detect = Detect()
    ranking: Ranking = field(default_factory=Ranking)
    output: Output = Output()
    skip_low_confidence: bool = False
    all_architectures: bool = False
    formats: dict = field(default_factory=dict)

    @property
    def warnings(self) -> tuple[str, ...]:
        return self.extraction.warnings


# Presets (fixed values).
PROFILES = {
    "security": {"extraction": {"min_length": 6}, "output": {"only": ("url", "domain", "ipv4", "ipv6", "filepath", "regpath"), "min_score": 70}},
    "yara": {"extraction": {"min_length": 8}, "output": {"exclude": ("import", "export"), "min_score": 80, "format": "yara"}},
    "development": {"extraction": {"include_debug": True}, "output": {"max_results": 500, "min_score": 50}},
    "malware": {"output": {"only": ("url", "domain", "ipv4", "ipv6", "regpath", "b64", "user-agent-ish")}, "detect": {"custom": (("crypto_address", r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}"),)}},
}
PROFILES["dev"] = PROFILES["development"]


# Names that settings have in files (fixed values).
FORMAT_SETTINGS = {
    "pe": {"extract_version_info": "version_info", "extract_manifests": "manifests", "extract_string_tables": "string_tables"},
    "elf": {"include_build_id": "build_id", "include_note_sections": "notes", "process_dynamic_strings": "dynamic"},
    "macho": {"process_load_commands": "load_commands", "process_fat_binaries": "fat"},
}
WEIGHT_NAMES = {"section_weights": {"string_data": "StringData", "resources": "Resources", "readonly_data": "ReadOnlyData", "debug": "Debug", "writable_data": "WritableData", "code": "Code", "other": "Other"}, "semantic_boosts": {"format_string": "fmt"}}


def weights(name: str, given: dict, old: dict) -> dict:
    """Single weights over the old ones, by the names of files or the library's own."""
    own = {WEIGHT_NAMES[name].get(k, k): v for k, v in given.items()}
    if unknown := set(own) - set(SECTION_WEIGHTS if name == "section_weights" else BOOSTS):
        raise ValueError(f"unknown settings in {name}: {sorted(unknown)}")
    return {**old, **own}


def merged(config: Config, values: dict) -> Config:
    """Sections of a nested mapping over a configuration; an unknown section or name is an error."""
    for part, given in values.items():
        if part == "formats":
            switches = {k: {**config.formats.get(k, {}), **{FORMAT_SETTINGS.get(k, {}).get(s, s): x for s, x in v.items()}} for k, v in given.items()}
            switched(switches)  # names what is unknown
            config = replace(config, formats={**config.formats, **switches})
            continue
        old = getattr(config, part)
        if not isinstance(given, dict):
            config = replace(config, **{part: given})
            continue
        known = {f.name for f in fields(old)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings in {part}: {sorted(unknown)}")
        values = {k: tuple(v) if isinstance(v, list) else weights(k, v, getattr(old, k)) if isinstance(v, dict) else v for k, v in given.items()}
        config = replace(config, **{part: replace(old, **values)})
    return config


def load(path: str | None = None, profile: str | None = None, environment: dict | None = None) -> Config:
    """Defaults, then the file's settings, then the profile's, then the environment's."""
    environment = os.environ if environment is None else environment
    path = path or environment.get(f"{PREFIX}CONFIG")
    config, own = Config(), {}
    if path:
        values = tomllib.loads(Path(path).read_text())
        own = values.pop("profiles", {})
        config = merged(config, values)
    if profile:
        chosen = own.get(profile) or PROFILES.get(profile)
        if chosen is None:
            raise ValueError(f"unknown profile {profile}")
        config = merged(config, chosen)
    for name, part, key, kind in (("MIN_LEN", "extraction", "min_length", int), ("FORMAT", "output", "format", str), ("MAX_RESULTS", "output", "max_results", int)):
        if value := environment.get(PREFIX + name):
            config = merged(config, {part: {key: kind(value)}})
    return merged(config, {"output": {"color": False}}) if environment.get("NO_COLOR") else config
