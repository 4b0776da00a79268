"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the published algorithm (fixed value).
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard in [0, shards) of each unsigned 64-bit key.

    With one shard more, a key either stays or moves to the new shard.
    """
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        stride = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * stride).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def jump_column(key, shards: int):
    """``key`` (a 64-bit hash column) to its shard."""

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards))

    return shard_of(key)


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """Each row's shard by its key, and its gapless slot in the shard.

    Returns ``key``, size (UTF-8 bytes of the text plus 1), text_crc32, law = 'key', shard, slot and
    grown_shard, the shard if there were one more. Only the key and the number of shards decide the shard;
    rows with equal keys share one, and a null key counts as a key of its own. A null text counts as empty.
    Repeated rows have a slot each. An empty table gives no rows. Other columns are not read.

    Slots are numbered without gathering a shard in one task: rows are numbered within small buckets of
    each shard, and a prefix sum over the buckets' counts gives where each bucket begins.
    """
    buckets = max(64, -(-docs.count() // (shards * rows_per_bucket)))
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(F.col(key))
    keyed = docs.select(F.col(key).alias("k"), hashed.alias("h"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = keyed.withColumn("shard", jump_column(F.col("h"), shards)).withColumn("grown_shard", jump_column(F.col("h"), shards + 1)).withColumn("bucket", F.pmod(F.xxhash64("h", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    begins = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    numbered = placed.withColumn("r", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("k", "size", "text_crc32")))
    out = numbered.join(begins, ["shard", "bucket"])
    return out.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("r") - F.lit(1)).cast("long").alias("slot"), "grown_shard")
