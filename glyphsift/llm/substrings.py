"""Substring deduplication over words: super-k-mers of minimisers, counted exactly by sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sliding_min, word_hashes, word_spans
from .repeats import Repeats


class Words:
    """Windows of ``k`` words, minimisers over parts of ``m`` words; packed strings are words joined by one space."""

    by_key = True

    def __init__(self, k: int = 13, m: int = 4):
        self.k, self.m = k, min(m, k)

    def read(self, raw: np.ndarray, at: np.ndarray):
        start, end, first = word_spans(raw, at)
        hashes = word_hashes(raw, start, end)
        n = len(hashes) - self.m + 1
        parts = np.zeros(max(n, 0), np.uint64)
        for j in range(self.m if n > 0 else 0):
            parts += hashes[j : j + n] * np.uint64(2 * j + 3)
        parts = mixed(parts)
        return first, (start, end), sliding_min(parts, self.k - self.m + 1), parts

    def cutter(self, raw: np.ndarray, units):
        start, end = units
        # words one after another with a space behind each
        size = end - start + 1
        to = np.cumsum(size) - size
        even = np.full(int(size.sum()), 32, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[start] = 1
        inside[end] -= 1
        mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        target = np.ones(len(even), bool)
        target[to + size - 1] = False
        even[target] = raw[mask]
        data, begins, ends = even.tobytes(), to.tolist(), (to + size - 1).tolist()
        return lambda a, z: data[begins[a] : ends[z - 1]]

    def window_counts(self, strings: list[bytes]) -> np.ndarray:
        return np.array([s.count(b" ") + 2 - self.k for s in strings], np.int64)

    def later(self, strings: list[bytes], keys: np.ndarray):
        """Sorts all windows exactly: words become numbers, and ranks of longer and longer sequences are sorted."""
        counts = np.array([s.count(b" ") + 1 for s in strings], np.int64)
        words = pa.array([w for s in strings for w in s.split(b" ")], pa.binary()).dictionary_encode()
        rank = words.indices.to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        have = 1
        while have < self.k:
            step = min(have, self.k - have)
            pair = rank[: len(rank) - step] * np.int64(len(rank) + len(words.dictionary) + 1) + rank[step:]
            rank, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
        # only windows inside a string count
        windows = counts - self.k + 1
        begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(int(windows.sum()))
        rank = rank[begin]
        order = np.argsort(rank, kind="stable")  # equal windows by their key
        ranked, who = rank[order], np.repeat(keys, windows)
        head = np.ones(len(rank), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        least = who[order][head][np.cumsum(head) - 1]
        again = np.zeros(len(rank), bool)
        again[order] = who[order] > least
        return spans_of(again, np.repeat(np.arange(len(strings)), windows), begin - np.repeat(first[:-1], windows))

    def kept(self, batch, covered: np.ndarray) -> list[bytes]:
        start, end = batch.units
        data, out = batch.raw.tobytes(), []
        for a, z in zip(batch.first[:-1].tolist(), batch.first[1:].tolist(), strict=True):
            live = np.flatnonzero(~covered[a:z]) + a
            out.append(b" ".join([data[s:e] for s, e in zip(start[live].tolist(), end[live].tolist(), strict=True)]))
        return out


def spans_of(marked: np.ndarray, string: np.ndarray, offset: np.ndarray):
    """Marked windows as (string, first window, windows): those that follow each other in a string together."""
    at = np.flatnonzero(marked)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (string[at[1:]] != string[at[:-1]])
    head = np.flatnonzero(new)
    return string[at[head]], offset[at[head]], np.diff(np.append(head, len(at)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 13, **how) -> DataFrame:
    """Removes each word in a window of ``k`` words whose sequence starts earlier in the corpus.

    Earlier means: in a document with a smaller key. A window that repeats only inside its own document stays.
    Returns key, n_units (words), n_removed, spans of removed words, kept (words left, joined by one space).
    Windows are judged on the input. Null and empty texts, and those under ``k`` words, keep all; very long
    texts are read whole. Null keys are one key, the first; repeated rows are judged alike. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    return Repeats(Words(k), **how).run(docs, key, text).select(F.col("k").alias(key), "n_units", "n_removed", "spans", F.col("kept").cast("string").alias("kept"))
