"""The score of a string, 0 to 100, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sections import choose

# Weights, boosts and penalties (fixed values).
SECTION_WEIGHTS = {"StringData": 40, "Resources": 35, "ReadOnlyData": 25, "Debug": 15, "WritableData": 10, "Code": 5, "Other": 0}
FORMAT_BONUS = (("Elf", ".rodata.str1.1"), ("Pe", ".rsrc"), ("MachO", "__TEXT,__cstring"))
BOOSTS = {"url": 25, "domain": 25, "ipv4": 25, "ipv6": 25, "guid": 20, "email": 20, "filepath": 15, "regpath": 15, "user-agent-ish": 15, "version": 12, "manifest": 12, "fmt": 10, "b64": 10, "import": 8, "export": 8, "resource": 5}
BANDS = ((90, "90-100"), (80, "80-89"), (70, "70-79"), (60, "60-69"), (50, "50-59"), (40, "40-49"), (30, "30-39"), (0, "0-29"))


@dataclass(frozen=True)
class Ranking:
    """Multipliers and overrides of the weights."""

    section_weights: dict = field(default_factory=lambda: dict(SECTION_WEIGHTS))
    semantic_boosts: dict = field(default_factory=lambda: dict(BOOSTS))
    section_weight_multiplier: float = 1.0
    semantic_boost_multiplier: float = 1.0
    noise_penalty_multiplier: float = 1.0

    def __hash__(self):
        return id(self)


def lookup(values: dict, key: Column) -> Column:
    """The value of a key, or 0."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(0))


def section_weight(section_type: Column, weights: dict = SECTION_WEIGHTS) -> Column:
    return lookup(weights, section_type)


def format_bonus(format: Column, section: Column) -> Column:
    hit = [(format == f) & (section == s) for f, s in FORMAT_BONUS]
    return F.when(hit[0] | hit[1] | hit[2], 5).otherwise(0)


def encoding_confidence(encoding: Column, printable: Column) -> Column:
    """``printable``: share of printable characters."""
    wide = F.when(printable > 0.90, 8).when(printable > 0.70, 5).otherwise(2)
    return F.when(encoding.isin("utf-16le", "utf-16be"), wide).otherwise(F.when(printable > 0.95, 10).when(printable > 0.80, 7).otherwise(3))


def semantic_boost(tags: Column, boosts: dict = BOOSTS) -> Column:
    """The sum over tags, and 3 for each tag beyond the first."""
    total = F.aggregate(F.transform(tags, lambda t: lookup(boosts, t)), F.lit(0), lambda a, b: a + b)
    return total + F.when(F.size(tags) > 1, (F.size(tags) - 1) * 3).otherwise(0)


def context_boost(boost: Column, section_type: Column, is_symbol: Column) -> Column:
    """A fifth more, truncated, in string data and resources; 5 more for symbols."""
    raised = F.when(section_type.isin("StringData", "Resources"), F.floor(boost * 6 / F.lit(5)).cast("int")).otherwise(boost)
    return raised + F.when(is_symbol, 5).otherwise(0)


def entropy_penalty(entropy: Column) -> Column:
    return F.when(entropy > 4.5, -15).when(entropy > 3.8, -8).otherwise(0)


def length_penalty(n_bytes: Column) -> Column:
    return F.when(n_bytes <= 50, 0).when(n_bytes <= 200, -2).when(n_bytes <= 500, -5).when(n_bytes <= 1000, -10).otherwise(-20)


def repetition_penalty(top_share: Column) -> Column:
    """``top_share``: the most frequent character's share (our reading of the undefined ratio)."""
    return F.when(top_share > 0.7, -12).when(top_share > 0.5, -6).otherwise(0)


def noise_penalty(text: Column) -> Column:
    """Only blanks or NULs; mostly hexadecimal digits; many tabs or commas: the first that holds."""
    hexes = F.length(F.regexp_replace(text, "[^0-9a-fA-F]+", ""))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.when(~text.rlike(r"[^ \x00]"), -20).when(hexes * 10 > F.octet_length(text) * 8, -10).when((count("\t") > 3) | (count(",") > 5), -8).otherwise(0)


def score(text: Column, encoding: Column, section: Column, section_type: Column, format: Column, source: Column, tags: Column, length: Column, printable: Column, entropy: Column, top_share: Column, ranking: Ranking | None = None) -> Column:
    ranking = ranking or Ranking()
    times = lambda c, by: c if by == 1 else F.floor(c * F.lit(by)).cast("int")
    gain = times(section_weight(section_type, ranking.section_weights), ranking.section_weight_multiplier) + format_bonus(format, section) + encoding_confidence(encoding, printable)
    boost = times(context_boost(semantic_boost(tags, ranking.semantic_boosts), section_type, source.isin("ImportName", "ExportName")), ranking.semantic_boost_multiplier)
    loss = entropy_penalty(entropy) + length_penalty(length) + repetition_penalty(top_share) + noise_penalty(text)
    return F.least(F.lit(100), F.greatest(F.lit(0), gain + boost + times(loss, ranking.noise_penalty_multiplier))).cast("int")


def band(score_: Column) -> Column:
    return choose([(score_ >= low, name) for low, name in BANDS], "0-29")


def char_stats(text: Column) -> tuple[Column, Column, Column]:
    """(printable share, entropy, top share) of a text column, where a scan hasn't given them."""
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.length(F.regexp_replace(text, r"[^\x20-\x7E]+", "")) / F.length(text), entropy, F.array_max(counts)
