"""Names of symbols as people write them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Escapes of the legacy mangling (fixed values).
ESCAPES = {"$SP$": "@", "$BP$": "*", "$RF$": "&", "$LT$": "<", "$GT$": ">", "$LP$": "(", "$RP$": ")", "$C$": ","}


def demangled(name: str | None) -> str | None:
    """A legacy ``_ZN...E`` name as a path without its hash; any other name as it is."""
    if not name:
        return name
    at = next((len(p) for p in ("_ZN", "__ZN", "ZN") if name.startswith(p)), 0)
    parts = []
    while at and at < len(name) and name[at] != "E":
        number = re.match(r"\d+", name[at:])
        if not number:
            return name
        at += number.end()
        part = name[at : at + int(number[0])]
        if len(part) < int(number[0]):
            return name
        parts.append(part)
        at += len(part)
    if not parts or at >= len(name):
        return name
    if re.fullmatch(r"h[0-9a-f]{16}", parts[-1]):
        parts.pop()
    text = "::".join(parts)
    for code, plain in ESCAPES.items():
        text = text.replace(code, plain)
    text = re.sub(r"\$u([0-9a-f]{1,6})\$", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"(^|::)_(?=<)", r"\1", text.replace("..", "::"))


@F.pandas_udf(StringType())
def _demangle(names: pd.Series) -> pd.Series:
    return names.map(demangled)


def demangle(name: Column) -> Column:
    """Only names that look mangled go through Python."""
    return F.when(name.rlike("^_?_?ZN"), _demangle(name)).otherwise(name)
