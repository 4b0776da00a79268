"""The corpus pipeline: five stages over documents, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that its caller writes as Parquet and reads
again as the next stage's docs; ``run`` does so in the shared folder. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsift.llm import contamination, jaccard, mixing, quality, sharding
from glyphsift.llm.common import fresh_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Null and empty texts are rejected; repeated rows are judged alike and all stay or go; an empty table stays
    empty.
    """
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; of its rows with one text one.

    Null, empty and wordless texts are linked with nothing and stay. A null doc_id stays only where its group
    has no other; an empty table stays empty.
    """
    named = jaccard.classes(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    stays = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(name.alias("name")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), F.col("text").alias("text"))
    first = Window.partitionBy("name", "text").orderBy("name")
    left = held.join(stays.hint("merge"), "name").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return left.select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, with all their rows; null and empty texts stay."""
    return contamination.Decontaminator(docs, table(spark, sf_dir, "benchmark")).clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and repeat, its text the words taken, in order.

    A document that is taken whole keeps its text as it is.
    """
    return mixing.mix_texts(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot; a null text counts as empty, a null doc_id as a key of its own."""
    return sharding.assign(docs, shards=16)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can't express the stages' models, alignments and draws; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
