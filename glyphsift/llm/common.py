"""Helpers that several operators share: tables, the shared folder, words."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session without one, as in tests, gets a temporary folder of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="glyphsift-"))
    return jsc.getCheckpointDir().get()


#: Rows of a few numbers for each file of a small table.
FILE_ROWS = 1 << 15


def saved(df: DataFrame, rows: int | None = None, slow: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor loses nothing.

    ``rows``: how many rows of a few numbers there are at most, if that is known. They go into few files, however
    many partitions a shuffle has: for each file Hadoop may start processes from the executor's JVM, which count as
    large as it is until they run their program. The last step runs in as many tasks as there are files; if it is
    ``slow``, it keeps its tasks, which start no process then, and its rows are shuffled evenly into the files.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        files = max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // FILE_ROWS)
        df = df.repartition(files) if slow else df.coalesce(files)
    return df.checkpoint(eager=True)


def swept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Like ``saved``, for large steps: lets Spark drop the shuffle files of finished steps now.

    It does so when the driver collects its garbage, which on a driver with little to do may be far too late.
    """
    out = saved(df, rows)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``fresh_dir`` named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Gives a worker's free memory back to the system; an idle worker is kept, and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN), lambda w: w != F.lit(""))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of the whole column; sizes the number of buckets."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def joined_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (all bytes, offsets of n + 1 rows); a null row is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Which bytes belong to words: all but white space; and letters, digits and what isn't ASCII.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(raw: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of joined texts: their starts and ends in ``raw``, and the first word of each of n + 1 rows.

    A word ends at a byte that ``kind`` leaves out and at the end of its row.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that close values spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words longer than this are hashed one by one.
LONG_WORD = 1024


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    length = end - start
    eights = np.ndarray((len(raw),), "<u8", raw.tobytes() + bytes(8), 0, (1,)).astype(np.uint64)
    masks = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)
    live = np.arange(len(start))
    for k in range(0, LONG_WORD, 8):
        if k:
            live = live[length[live] > k]
            if not len(live):
                break
        part = eights[start[live] + k] & masks[np.minimum(length[live] - k, 8)]
        h = (out[live] ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out[live] = h ^ (h >> np.uint64(29))
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return mixed(out + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    out = x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out[:n]
