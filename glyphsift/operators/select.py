"""Filters, orders and limits over found strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only(df: DataFrame, *tags: str) -> DataFrame:
    """Strings with any of the tags."""
    return df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def exclude(df: DataFrame, *tags: str) -> DataFrame:
    """Strings with none of the tags."""
    return df.where(~F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def in_sections(df: DataFrame, *names: str) -> DataFrame:
    """Strings of the sections, named in full or by what follows the comma."""
    return df.where(F.col("section").isin(*names) | F.element_at(F.split("section", ","), -1).isin(*names))


def min_score(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("score") >= least)


def without_debug(df: DataFrame) -> DataFrame:
    return df.where("section_type <> 'Debug'")


def rank_order() -> list[Column]:
    """By score; ties go by path, offset and text, as Spark's sort keeps no order of its own."""
    return [F.col("score").desc(), F.col("path"), F.col("offset"), F.col("text"), F.col("encoding")]


def top(df: DataFrame, n: int | None = 100) -> DataFrame:
    """The n best in order; None keeps all."""
    ordered = df.orderBy(*rank_order())
    return ordered if n is None else ordered.limit(n)


def numbered(df: DataFrame, parts: int = 64, sample: int = 6400) -> DataFrame:
    """With ``place``, each row's number in rank order from 1, without a window over all rows.

    Rows are dealt by ``parts`` bounds, taken from about ``sample`` rows by a hash of their place in the file. A part's
    first number is the prefix sum of the counts before it; whatever the bounds are, the numbers are the same.
    """
    key = F.struct((-F.col("score")).alias("s"), "path", "offset", "text", "encoding")
    rows = df.select("*", key.alias("key"))
    n = max(1, rows.count())
    share = F.pmod(F.xxhash64("path", "offset"), F.lit(1 << 20)) < F.lit(max(1, round(min(1.0, sample / n) * (1 << 20))))
    seen = sorted(tuple(r["key"]) for r in rows.where(share).select("key").limit(4 * sample).collect())
    bounds = [seen[i * len(seen) // parts] for i in range(1, parts)] if seen else []
    as_key = lambda b: F.struct(F.lit(b[0]).alias("s"), F.lit(b[1]).alias("path"), F.lit(b[2]).cast("long").alias("offset"), F.lit(b[3]).alias("text"), F.lit(b[4]).alias("encoding"))
    part = F.size(F.filter(F.array(*map(as_key, bounds)), lambda b: b < F.col("key"))) if bounds else F.lit(0)
    dealt = rows.withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = [sum(n for p, n in sizes.items() if p < q) for q in range(len(bounds) + 1)]
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part"))
    return dealt.withColumn("place", start + F.row_number().over(Window.partitionBy("part").orderBy("key"))).drop("part", "key")


def top_each(df: DataFrame, n: int, by: str = "path") -> DataFrame:
    """The n best of each path."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*rank_order()))).where(F.col("rank") <= n)


def neighbours(df: DataFrame, k: int = 2) -> DataFrame:
    """With ``surrounding``: the texts of up to k strings before and after in the same section."""
    near = Window.partitionBy("path", "section").orderBy("offset").rowsBetween(-k, k)
    return df.withColumn("surrounding", F.collect_list("text").over(near))


def section_attributes(df: DataFrame, sections: DataFrame) -> DataFrame:
    """Strings with the columns of their section: an equi-join on path and section.

    Only for attributes that the scan doesn't carry; those it does need no join.
    """
    return df.join(sections, ["path", "section"])


def mask(df: DataFrame, known: DataFrame) -> DataFrame:
    """Without the strings of a list of known texts."""
    return df.join(known.select(F.col("text").alias("known")).distinct(), F.col("text") == F.col("known"), "left_anti")


def known_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """With ``is_known``: whether the text is among the names."""
    seen = names.select(F.col("name").alias("text")).distinct().withColumn("is_known", F.lit(True))
    return df.join(seen, "text", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(text, change): texts of only one of two versions, added or removed."""
    a, b = (df.select("text").distinct().withColumn(c, F.lit(True)) for df, c in ((old, "was"), (new, "is")))
    both = a.join(b, "text", "full_outer")
    return both.where("was IS NULL OR is IS NULL").select("text", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))


def referenced(strings: DataFrame, relocations: DataFrame, bin_bytes: int = 4096) -> DataFrame:
    """Strings to which a relocated address points: (path, text, rva, address).

    An interval join as an equi-join over bins of addresses: a string is listed in each bin it reaches into.
    """
    low, high = F.col("rva"), F.col("rva") + F.col("length") - 1
    bin_of = lambda c: F.floor(c / F.lit(bin_bytes)).cast("long")
    spread = strings.where("rva IS NOT NULL").select("path", "text", "rva", "length", F.explode(F.sequence(bin_of(low), bin_of(high))).alias("bin"))
    at = relocations.select("path", "address", bin_of(F.col("address")).alias("bin"))
    return spread.join(at, ["path", "bin"]).where((F.col("address") >= F.col("rva")) & (F.col("address") < F.col("rva") + F.col("length"))).select("path", "text", "rva", "address")
