"""Counts and summaries of found strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsift.functions.rank import band


def count_by_tag(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def count_by_section(df: DataFrame) -> DataFrame:
    return df.groupBy("section").agg(F.count("*").alias("n"))


def distinct_texts(df: DataFrame) -> DataFrame:
    return df.select("text").distinct()


def summary(df: DataFrame, confident: int = 80) -> DataFrame:
    """total_strings and high_confidence."""
    return df.agg(F.count("*").alias("total_strings"), F.count_if(F.col("score") >= confident).alias("high_confidence"))


def by_category(df: DataFrame) -> DataFrame:
    """Strings and distinct texts of each primary tag (the first one)."""
    return df.where(F.size("tags") > 0).groupBy(F.get("tags", F.lit(0)).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.max("score").alias("best"))


def by_band(df: DataFrame) -> DataFrame:
    return df.groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def by_confidence(df: DataFrame) -> DataFrame:
    level = F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low")
    return df.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
