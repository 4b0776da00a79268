"""Suffix-array deduplication over the bytes of texts.

Shards are filled by content: texts are cut into runs of windows (see ``repeats``), and only runs whose
minimiser occurs twice or more are shipped, so equal windows meet in one bucket. A bucket is cut, in order of
occurrence, into shards of bounded size. Each shard gets a suffix array by Larsson-Sadakane refinement and
Kasai's common prefixes; then the windows of each later shard are looked up in the sorted windows of each
earlier one by binary search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliding_min
from .repeats import Repeats
from .substrings import spans_of


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one big-endian number; past the end they count as zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def suffix_array(raw: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions sorted by their suffixes; which of them share their first ``known`` bytes with the one before; known.

    ``known`` is the longest prefix up to ``depth`` bytes that a round leaves behind, 8 or a double of it.

    Larsson-Sadakane: a suffix's rank is where its group of equal prefixes begins; each round sorts only the
    members of unsorted groups, by the rank of the suffix ``have`` bytes on, and doubles the known prefix.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool), 8
    order = np.argsort(words)
    key = words[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    # only the last 7 suffixes are shorter than their key; they move within their keys' groups
    for p in range(n - 1, max(-1, n - 8), -1):
        a, z = np.searchsorted(key, words[p], "left"), np.searchsorted(key, words[p], "right")
        group = order[a:z]
        by = np.argsort(np.minimum(n - group, 8), kind="stable")
        order[a:z] = group = group[by]
        left = np.minimum(n - group, 8)
        head[a + 1 : z] |= left[1:] != left[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    have = known = 8
    tied = ~head
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of unsorted groups
    while len(open_):
        members = order[open_]
        ahead = members + have
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[members].astype(np.uint64) * np.uint64(n + 1) + nxt.astype(np.uint64)
        by = np.argsort(pair)
        pair, members = pair[by], members[by]
        order[open_] = members
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[members] = np.maximum.accumulate(np.where(new, open_, 0))
        at = open_
        open_ = open_[~(new & np.append(new[1:], True))]
        have *= 2
        if have <= depth:
            known = have
            tied = np.zeros(n, bool)
            tied[at] = ~new
    return order, tied, known


def common_prefixes(words: np.ndarray, order: np.ndarray, tied: np.ndarray, known: int, most: int, lanes: int = 8192) -> np.ndarray:
    """Kasai: for each place of the suffix array, the prefix it shares with the place before, up to ``most`` bytes.

    Only tied places are asked, those that share ``known`` bytes at least; the others count 0. In text order
    the shared prefix shrinks by at most one from a position to the next, so it is kept and only extended.
    Many stretches of the text go side by side.
    """
    n = len(order)
    shared = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    at = np.flatnonzero(tied)
    before[order[at]] = order[at - 1]
    place = np.flatnonzero(before >= 0)  # in text order
    if not len(place):
        return shared
    lanes = max(1, min(lanes, len(place) // 16))
    size = -(-len(place) // lanes)
    h, last = np.zeros(lanes, np.int64), np.full(lanes, -2, np.int64)
    for step in range(size):
        i = np.arange(step, len(place), size)
        p = place[i]
        q, k = before[p], len(i)
        h[:k] = np.maximum(np.where(p == last[:k] + 1, h[:k] - 1, 0), known)
        last[:k] = p
        live = np.flatnonzero(h[:k] < most)
        while len(live):
            a, b = p[live] + h[live], q[live] + h[live]
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            grown = np.minimum(_leading_equal(words[a] ^ words[b]), np.minimum(n - a, n - b))
            h[live] += grown
            live = live[(grown == 8) & (h[live] < most)]
        shared[p] = np.minimum(h[:k], most)
    return shared[order]


def _leading_equal(differ: np.ndarray) -> np.ndarray:
    """Zero bytes at the front of big-endian 64-bit numbers."""
    out = np.full(len(differ), 8, np.int64)
    d = differ
    for i in range(7, -1, -1):
        out[d >= (np.uint64(1) << np.uint64(8 * (7 - i)))] = i
    return out


class Shard:
    """Packed strings in order of occurrence, their windows sorted by a suffix array."""

    def __init__(self, strings: list[bytes], k: int):
        self.k = k
        length = np.array([len(s) for s in strings], np.int64)
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.words = eights(self.raw)
        first = np.cumsum(length) - length
        count = length - k + 1
        self.string = np.repeat(np.arange(len(strings)), count)
        self.offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.window = first[self.string] + self.offset
        order, tied, known = suffix_array(self.raw, self.words, k)
        shared = common_prefixes(self.words, order, tied, known, k)
        number = np.full(len(self.raw), -1, np.int64)
        number[self.window] = np.arange(len(self.window))
        group = np.cumsum(shared < k)
        at = number[order]
        group, at = group[at >= 0], at[at >= 0]
        # windows in order of their bytes; those of one group are equal, and the least number is the earliest
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        heads = np.flatnonzero(head)
        self.earliest = np.minimum.reduceat(at, heads) if len(heads) else np.zeros(0, np.int64)
        self.again = np.ones(len(self.window), bool)
        self.again[self.earliest] = False
        self.sorted = self.window[self.earliest]  # one position for each distinct window, in order

    def compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """Signs of my windows against the other's, eight bytes at a time."""
        sign, live = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for i in range(0, self.k, 8):
            a, b = self.words[mine[live] + i], other.words[theirs[live] + i]
            if self.k - i < 8:
                drop = np.uint64(8 * (8 - (self.k - i)))
                a, b = a >> drop, b >> drop
            sign[live] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            live = live[a == b]
            if not len(live):
                break
        return sign

    def found_in(self, earlier: Shard) -> np.ndarray:
        """Which of my distinct windows the earlier shard has, by binary search in its sorted ones.

        The first search is by the windows' first eight bytes, which bounds the places of the second.
        """
        out = np.zeros(len(self.sorted), bool)
        keys, mine = earlier.words[earlier.sorted], self.words[self.sorted]
        low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        asked = np.flatnonzero(low < high)
        mine, low, high = self.sorted[asked], low[asked], high[asked]
        live = np.arange(len(asked))
        while len(live):
            middle = (low[live] + high[live]) // 2
            sign = self.compare(mine[live], earlier, earlier.sorted[middle])
            out[asked[live[sign == 0]]] = True
            low[live] = np.where(sign > 0, middle + 1, low[live])
            high[live] = np.where(sign < 0, middle, high[live])
            live = live[(sign != 0) & (low[live] < high[live])]
        return out


class Bytes:
    """Windows of ``k`` bytes, minimisers over parts of 32 bytes; a packed string is the bytes themselves.

    Shorter parts would make longer runs, but phrases of 16 bytes are too often in unrelated texts.
    """

    by_key = False

    def __init__(self, k: int = 100, shard_bytes: int = 1 << 20):
        if k < 32:
            raise ValueError("windows are at least 32 bytes")
        self.k, self.shard_bytes = k, shard_bytes

    def read(self, raw: np.ndarray, at: np.ndarray):
        if len(raw) < 32:
            return at, None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        # in stretches that stay in the processor's caches
        n, width = len(raw) - 31, self.k - 31
        eights = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,))
        parts, least = np.empty(n, np.uint64), np.empty(max(0, n - width + 1), np.uint64)
        for a in range(0, n, 1 << 15):
            z = min(a + (1 << 15), n)
            words = eights[a : z + 24].astype(np.uint64)
            x = words[: z - a] * np.uint64(0x9E3779B97F4A7C15)
            for i, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
                x += words[i : i + z - a] * np.uint64(odd)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            parts[a:z] = x
        for a in range(0, len(least), 1 << 15):
            z = min(a + (1 << 15), len(least))
            least[a:z] = sliding_min(parts[a : z + width - 1], width)
        return at, None, least, parts

    def cutter(self, raw: np.ndarray, units):
        data = raw.tobytes()
        return lambda a, z: data[a:z]

    def window_counts(self, strings: list[bytes]) -> np.ndarray:
        return np.array([len(s) - self.k + 1 for s in strings], np.int64)

    def later(self, strings: list[bytes], keys: np.ndarray):
        """The windows that start earlier in the same shard, or, by binary search, in a shard before it."""
        shards, begin, size, bounds = [], 0, 0, []
        for i, s in enumerate(strings):
            size += len(s)
            if size >= self.shard_bytes or i == len(strings) - 1:
                bounds.append((begin, i + 1))
                begin, size = i + 1, 0
        out = []
        for begin, end in bounds:
            shard = Shard(strings[begin:end], self.k)
            known = np.zeros(len(shard.sorted), bool)
            for earlier in shards:
                known |= shard.found_in(earlier)
            again = shard.again.copy()
            again[shard.earliest[known]] = True
            which, offset, windows = spans_of(again, shard.string, shard.offset)
            out.append((which + begin, offset, windows))
            shard.again = shard.string = shard.offset = shard.window = None
            shards.append(shard)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def kept(self, batch, covered: np.ndarray) -> list[bytes]:
        live = ~covered
        left = batch.raw[live].tobytes()
        end = np.concatenate([[0], np.cumsum(live)])[batch.at].tolist()
        return [left[a:z] for a, z in zip(end[:-1], end[1:], strict=True)]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 100, **how) -> DataFrame:
    """Removes each byte in a string of ``k`` bytes that also starts earlier in the corpus.

    Earlier means: in a document with a smaller key, or further left in the same one. Texts are UTF-8 bytes
    and matches never cross documents; strings are judged on the input. Returns key, n_units (bytes),
    n_removed, spans of removed bytes, kept (the bytes left). Null and empty texts, and those under ``k``
    bytes, keep all; very long texts are read whole. Rows with one key go by a hash of their key and text,
    repeated rows one after another; a null key comes first. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    return Repeats(Bytes(k), **({"bucket_bytes": 2 << 20} | how)).run(docs, key, text).select(F.col("k").alias(key), "n_units", "n_removed", "spans", "kept")
