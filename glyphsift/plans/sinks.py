"""Found strings as lines of text: DataFrame -> DataFrame of one column ``value``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsift.schemas import FOUND

#: format name -> function of found strings; ``register`` adds to it.
FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def put(f):
        FORMATTERS[name] = f
        return f

    return put


def display(text: Column, width: int = 80) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


@register("json")
def json_lines(df: DataFrame) -> DataFrame:
    """One object a string, its nine fields in order, nulls included."""
    return df.select(F.to_json(F.struct(*FOUND), {"ignoreNullFields": "false"}).alias("value"))


@register("human")
def human(df: DataFrame, width: int = 80, color: bool = False) -> DataFrame:
    """Score, offset, section, encoding, tags and text in columns."""
    offset = F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex("offset"))), F.lit("-"))
    tags = F.array_join("tags", ",")
    line = F.format_string("%5d  %-10s  %-16s  %-8s  %-20s  %s", F.col("score"), offset, F.coalesce("section", F.lit("-")), F.col("encoding"), tags, display(F.col("text"), width))
    if color:
        code = F.when(F.col("score") >= 80, "\x1b[32m").when(F.col("score") >= 50, "\x1b[33m").otherwise("\x1b[31m")
        line = F.concat(code, line, F.lit("\x1b[0m"))
    return df.select(line.alias("value"))


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


@register("csv")
def csv(df: DataFrame) -> DataFrame:
    """text, encoding, offset, section, tags, score; tags are joined by ``|``."""
    parts = [csv_field(F.col("text")), F.col("encoding"), F.coalesce(F.col("offset").cast("string"), F.lit("")), csv_field(F.coalesce("section", F.lit(""))), F.array_join("tags", "|"), F.col("score").cast("string")]
    return df.select(F.concat_ws(",", *parts).alias("value"))


@register("markdown")
def markdown(df: DataFrame) -> DataFrame:
    cells = [F.col("score").cast("string"), F.coalesce("section", F.lit("")), F.array_join("tags", ","), F.replace(display(F.col("text")), F.lit("|"), F.lit("\\|"))]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


@register("xml")
def xml(df: DataFrame) -> DataFrame:
    """One element a string; control characters, which XML can't hold, become spaces."""
    text = F.col("text")
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return df.select(F.format_string('<string score="%d" offset="%s" encoding="%s" tags="%s">%s</string>', F.col("score"), F.coalesce(F.col("offset").cast("string"), F.lit("")), F.col("encoding"), F.array_join("tags", ","), text).alias("value"))


def yara_text(text: Column, encoding: Column) -> Column:
    """A quoted string, or hexadecimal bytes where it isn't printable."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    pairs = F.concat(F.lit("{ "), F.trim(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 ")), F.lit(" }"))
    modifier = F.when(encoding.startswith("utf-16"), " wide").otherwise(" ascii")
    return F.when(text.rlike(r"^[\x20-\x7E\t]*$"), F.concat(quoted, modifier)).otherwise(pairs)


def rule_ids(df: DataFrame) -> DataFrame:
    """With ``rule_id``: tag and number by score within its path, such as url_1."""
    tag = F.regexp_replace(F.coalesce(F.get("tags", F.lit(0)), F.lit("string")), "[^a-z0-9]", "_")
    numbered = Window.partitionBy("path", "primary").orderBy(F.col("score").desc(), "offset", "text", "encoding")
    return df.withColumn("primary", tag).withColumn("rule_id", F.concat("primary", F.lit("_"), F.row_number().over(numbered).cast("string")))


@register("yara")
def yara(df: DataFrame, least: int = 80) -> DataFrame:
    """A rule for each path of its strings at ``least`` or more, grouped by tag."""
    lines = rule_ids(df.where(F.col("score") >= least)).withColumn("line", F.concat(F.lit("        $"), "rule_id", F.lit(" = "), yara_text(F.col("text"), F.col("encoding"))))
    body = F.array_sort(F.collect_list(F.struct("primary", (-F.col("score")).alias("s"), "rule_id", "line")))
    rules = lines.groupBy("path").agg(body.alias("rows"))
    base = F.element_at(F.split("path", "/"), -1)
    name = F.concat(F.when(base.rlike("^[0-9]"), "_").otherwise(""), F.regexp_replace(base, "[^A-Za-z0-9_]", "_"), F.lit("_strings"))
    text = F.concat(F.lit("rule "), name, F.lit(" {\n    meta:\n        description = \"Strings extracted from "), F.replace(F.replace(base, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"\n\n    strings:\n'), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n\n    condition:\n        any of them\n}"))
    return rules.select("path", text.alias("value"))


def write(df: DataFrame, format: str, path: str) -> None:
    """Lines of a format as text files, or Parquet."""
    if format == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        FORMATTERS[format](df).select("value").write.mode("overwrite").text(path)
