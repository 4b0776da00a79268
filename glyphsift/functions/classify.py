"""Semantic tags of a string, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns (fixed values; \x00 stands for NUL in both engines).
PATTERNS = {
    "url": r"https?://[^\s]+",
    "domain": r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "posix_path": r"/[^\x00\n\r]*",
    "windows_path": r"[A-Za-z]:\\[^\x00\n\r]*",
    "regpath": r"HKEY_[A-Z_]+\\[^\x00\n\r]*",
    "guid": r"\{[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "fmt": r"%[sdxo]|%\d+[sdxo]|\{\d+\}",
    "b64": r"[A-Za-z0-9+/]{20,}={0,2}",
    "user-agent-ish": r"Mozilla/[0-9.]+|Chrome/[0-9.]+|Safari/[0-9.]+",
    "version": r"\bv?\d+\.\d+(\.\d+)*\b",
}
# Custom patterns that a configuration may add (fixed values).
CUSTOM = {
    "api_key": r"[Aa][Pp][Ii]_?[Kk][Ee][Yy].*[0-9a-zA-Z]{32,}",
    "crypto_address": r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}",
    "jwt_token": r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
}
#: Ours: a top-level domain counts if it has two letters or is one of these. ``valid_tld`` takes other lists.
GENERIC_TLDS = tuple(
    "com net org edu gov mil int info biz name pro mobi jobs travel museum aero coop asia cat tel post arpa "
    "app dev page tech cloud online site website web space store shop shopping blog news media live life world today "
    "xyz top club fun icu vip work works agency academy art bank best bike build business cafe capital care center chat "
    "church city click coach codes college community company computer cool country credit design digital direct directory "
    "email energy engineering events exchange expert express family farm finance fit football foundation fund gallery games "
    "global gold group guide health help host hosting house institute international investments land law legal link loan "
    "local ltd management market marketing money monster network ninja onion parts photo photos plus press productions "
    "rest review reviews rocks run sale school science security services social software solutions studio support systems "
    "team tools tours town trade training university video watch wiki win wine zone".split()
)
#: The order in which tags are pushed.
ORDER = ("url", "domain", "ipv4", "ipv6", "filepath", "regpath", "guid", "email", "fmt", "b64", "user-agent-ish")


def _has(text: Column, name: str) -> Column:
    return text.rlike(PATTERNS[name])


# Each predicate asks first for a character that its pattern needs: most strings have none of them, and looking
# for one costs a small part of a pattern's time.


def valid_tld(text: Column, generic: tuple[str, ...] = GENERIC_TLDS) -> Column:
    tld = F.lower(F.regexp_extract(text, r"[a-zA-Z0-9.-]+\.([a-zA-Z]{2,})", 1))
    return (F.length(tld) == 2) | tld.isin(*generic)


def is_url(text: Column) -> Column:
    return text.contains("://") & _has(text, "url")


def is_domain(text: Column) -> Column:
    """A domain with a valid top-level domain, four bytes at least, and no URL."""
    return text.contains(".") & _has(text, "domain") & ~is_url(text) & (F.octet_length(text) >= 4) & valid_tld(text)


def is_ipv4(text: Column) -> Column:
    """The first dotted quad has no part over 255."""
    first = F.regexp_extract(text, PATTERNS["ipv4"], 0)
    return text.contains(".") & (first != "") & F.forall(F.split(first, r"\."), lambda x: x.try_cast("int") <= 255)


def is_ipv6(text: Column) -> Column:
    return text.contains(":") & _has(text, "ipv6")


def is_filepath(text: Column) -> Column:
    """What follows a slash may be nothing, so the slash alone decides."""
    return text.contains("/") | (text.contains(":\\") & _has(text, "windows_path"))


def is_regpath(text: Column) -> Column:
    return text.contains("HKEY_") & _has(text, "regpath")


def is_guid(text: Column) -> Column:
    return text.contains("{") & _has(text, "guid")


def is_email(text: Column) -> Column:
    return text.contains("@") & _has(text, "email")


def is_fmt(text: Column) -> Column:
    return (text.contains("%") | text.contains("{")) & _has(text, "fmt")


def is_b64(text: Column) -> Column:
    """The first run of the alphabet has a whole number of groups of four; or a URL's query holds one."""
    first = F.regexp_extract(text, PATTERNS["b64"], 0)
    return (F.octet_length(text) >= 20) & (first != "") & (F.length(first) % 4 == 0)


def is_b64_query(text: Column) -> Column:
    return text.contains("?") & is_url(text) & F.regexp_extract(text, r"\?(.*)$", 1).rlike(PATTERNS["b64"])


def is_user_agent(text: Column) -> Column:
    return text.contains("/") & _has(text, "user-agent-ish")


def is_version(text: Column, section_type: Column) -> Column:
    return (section_type == "Resources") & text.contains(".") & _has(text, "version")


PREDICATES = {"url": is_url, "domain": is_domain, "ipv4": is_ipv4, "ipv6": is_ipv6, "filepath": is_filepath, "regpath": is_regpath, "guid": is_guid, "email": is_email, "fmt": is_fmt, "b64": lambda t: is_b64(t) | is_b64_query(t), "user-agent-ish": is_user_agent}


@dataclass(frozen=True)
class Detect:
    """Which families are looked for, and patterns of one's own (name -> regular expression)."""

    urls: bool = True
    domains: bool = True
    ips: bool = True
    paths: bool = True
    registry: bool = True
    guids: bool = True
    emails: bool = True
    formats: bool = True
    base64: bool = True
    user_agents: bool = True
    versions: bool = True
    custom: tuple[tuple[str, str], ...] = ()

    def tags(self) -> tuple[str, ...]:
        on = {"url": self.urls, "domain": self.domains, "ipv4": self.ips, "ipv6": self.ips, "filepath": self.paths, "regpath": self.registry, "guid": self.guids, "email": self.emails, "fmt": self.formats, "b64": self.base64, "user-agent-ish": self.user_agents}
        return tuple(t for t in ORDER if on[t])


SOURCE_TAGS = (("ImportName", "import"), ("ExportName", "export"))


def tags(text: Column, section_type: Column, source: Column, detect: Detect = Detect(), classifiers=()) -> Column:
    """Tags in push order. ``classifiers``: functions text -> Column of a tag or null, applied last."""
    found = [F.when(PREDICATES[t](text), F.lit(t)) for t in detect.tags()]
    if detect.versions:
        found.append(F.when(is_version(text, section_type), F.lit("version")))
    found += [F.when(source == s, F.lit(t)) for s, t in SOURCE_TAGS]
    found.append(F.when(source == "ResourceString", F.when(text.startswith("<?xml") | text.contains("<assembly"), F.lit("manifest")).otherwise(F.lit("resource"))))
    found += [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in detect.custom]
    found += [c(text) for c in classifiers]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def confidence(text: Column, tag: Column, section_type: Column) -> Column:
    """0.5 and more for what supports the tag, at most 1."""
    url = F.when(text.startswith("https://"), 0.3).otherwise(0.0) + F.when(valid_tld(text), 0.2).otherwise(0.0)
    path = F.when(section_type == "StringData", 0.2).otherwise(0.0) + F.when(text.rlike(r"^(/[^/]+)+/?$") | text.rlike(r"^[A-Za-z]:\\"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(tag == "url", url).when(tag == "filepath", path).otherwise(0.0))


#: Least confidence for a tag to stay (fixed values).
THRESHOLDS = {"url": 0.8, "domain": 0.75, "filepath": 0.6}
OVERALL_THRESHOLD = 0.7


def results(text: Column, tags_: Column, section_type: Column) -> Column:
    """(tag, confidence, evidence) of each tag."""
    return F.transform(tags_, lambda t: F.struct(t.alias("tag"), confidence(text, t, section_type).alias("confidence"), F.array(F.concat(F.lit("pattern:"), t)).alias("evidence")))


def confident(results_: Column, thresholds=None, overall: float = OVERALL_THRESHOLD) -> Column:
    """Only results at their tag's threshold, or at the overall one."""
    limits = F.create_map(*[F.lit(x) for kv in (THRESHOLDS if thresholds is None else thresholds).items() for x in kv])
    return F.filter(results_, lambda r: r["confidence"] >= F.coalesce(F.try_element_at(limits, r["tag"]), F.lit(overall)))
