"""Equal strings as one, with all their occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift.functions.rank import section_weight


def canonical(text: Column) -> Column:
    """The key of a string: tabs and line ends are spaces, and blanks around it don't count. Case does."""
    return F.trim(F.regexp_replace(text, "[\t\n\r]", " "))


def deduplicate(strings: DataFrame) -> DataFrame:
    """One row for each path and canonical text, its occurrences in order of offset.

    Encoding and section are those of the occurrence in the weightiest section, of equals the first.
    """
    best = F.struct(section_weight(F.col("section_type")).alias("w"), (-F.col("offset")).alias("o"))
    return strings.groupBy("path", canonical(F.col("text")).alias("canonical_text")).agg(
        F.max_by("encoding", best).alias("primary_encoding"),
        F.max_by("section", best).alias("best_section"),
        F.array_sort(F.collect_list(F.struct("offset", "section", "encoding", "length"))).alias("occurrences"),
    )


def first_of_each(strings: DataFrame) -> DataFrame:
    """One whole row for each path and canonical text, the best occurrence's, with ``n_occurrences``.

    An aggregate of the row as a struct combines before the shuffle and holds one row a key, unlike a window.
    """
    best = F.struct(section_weight(F.col("section_type")).alias("w"), (-F.col("offset")).alias("o"))
    row = F.struct(*strings.columns)
    return strings.groupBy("path", canonical(F.col("text")).alias("canonical_text")).agg(F.max_by(row, best).alias("r"), F.count("*").alias("n_occurrences")).select("r.*", "n_occurrences")
