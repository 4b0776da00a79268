"""Finding and removing repeated windows of a corpus: what the byte and word operators share.

A window is ``k`` consecutive units (bytes or words) of one text. Each window's minimiser is the least hash
of its ``m``-unit parts, and consecutive windows with one minimiser are a run, packed as one string. Equal
windows have equal minimisers, so they meet wherever runs are dealt by minimiser. The steps, each a
shuffle of bounded groups:

1. ``batches``: texts are dealt into batches of about ``batch_bytes`` by a hash of their key and text.
2. ``announce``: each batch sends its minimisers, each once with its count, to the minimiser's bucket.
3. ``answer``: a bucket tells the batches which of their minimisers occur twice or more in the corpus, and
   which are frequent. A window with any other minimiser occurs once and needs no further work.
4. ``pack``: a batch cuts the runs of repeated minimisers out as packed strings. Equal strings within the
   batch are settled there. The rest go to the minimiser's bucket. Runs of frequent minimisers are cut into
   single windows, which repeats within the batch leave at once; each different one goes by its 96-bit
   digest to the digest's bucket, so a batch sends a window at most once, and a bucket gets it at most once
   from a batch.
5. ``settle``: a bucket finds every window's first occurrence, by the operator's own method, and returns the
   windows that start later. Of digests it takes the least place.
6. ``remove``: each batch deletes the units covered by those windows.

A window is earlier than another in a row with a larger key; rows of one key are in order of their batch, and
in the batch of their text. Nothing is collected, and every step can be computed again from the one before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_buffers, text_bytes

NO_KEY = np.iinfo(np.int64).min


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], "<i8")[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def blobs(column: pa.ChunkedArray) -> list[bytes]:
    return [b for b in column.to_pylist() if b is not None]


def runs(values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimiser, row) of each run; ``first`` has the first unit of each of n + 1 rows."""
    count = np.diff(first) - k + 1
    rows = np.flatnonzero(count > 0)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begin, stop = first[rows], first[rows] + count[rows]
    mark = np.zeros(len(values) + 1, bool)
    mark[1:-1] = values[1:] != values[:-1]
    mark[begin] = mark[stop] = True
    inside = np.zeros(len(values) + 1, np.int8)
    inside[begin] += 1
    inside[stop] -= 1
    np.cumsum(inside, out=inside, dtype=np.int8)
    at = np.flatnonzero(mark)
    ends = np.append(at[1:], len(values))
    keep = (inside[at] > 0) & (at < len(values))
    at, ends = at[keep], ends[keep]
    return at, ends - at, values[at], rows[np.searchsorted(begin, at, side="right") - 1]


def weights(start: np.ndarray, windows: np.ndarray, values: np.ndarray, mins: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """2 for runs in which the minimiser stands at two places or more, so that windows may repeat inside, else 1."""
    if not len(start):
        return np.zeros(0, np.int64)
    width = len(parts) - len(mins) + 1
    out = np.ones(len(start), np.int64)
    enters = np.concatenate([[0], np.cumsum(parts[width - 1 :] == mins)])
    out[enters[start + windows] > enters[start + 1]] = 2
    windows_ = np.lib.stride_tricks.sliding_window_view(parts, width)
    for a in range(0, len(start), 2048):
        first = windows_[start[a : a + 2048]] == values[a : a + 2048, None]
        out[a : a + 2048][np.count_nonzero(first, axis=1) > 1] = 2
    return out


def stretches(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (row, first place, windows) of those that follow each other."""
    by = np.lexsort((place, row))
    row, place = row[by], place[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], place[head], np.diff(np.append(head, len(row)))


class Singles:
    """The single windows of one batch, added in order of occurrence.

    The first of equal windows stands for all. Later ones start later; but where only a smaller key counts,
    those of the first one's key share its fate, and only their places are kept with it.
    """

    def __init__(self, by_key: bool):
        self.by_key, self.known, self.keys, self.which, self.places, self.late = by_key, {}, [], [], [], []

    def add(self, window: bytes, key: int, row: int, place: int) -> None:
        digest = hashlib.blake2b(window, digest_size=12).digest()
        i = self.known.setdefault(digest, len(self.keys))
        if i == len(self.keys):
            self.keys.append(key)
        elif not self.by_key or key != self.keys[i]:
            self.late.append((row, place))
            return
        self.which.append(i)
        self.places.append((row, place))

    def later(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(self.late, np.int64).reshape(-1, 2).T)

    def dealt(self, n: int):
        """(bucket, packed digests, keys and, by number of the digest, places), what ascends as differences."""
        digests = np.frombuffer(b"".join(self.known), "<u4").reshape(-1, 3)
        bucket = digests[:, 0].astype(np.int64) % n
        which, places, keys = np.array(self.which, np.int64), np.array(self.places, "<i4").reshape(-1, 2), np.array(self.keys, "<i8")
        by, at = np.argsort(bucket, kind="stable"), np.argsort(bucket[which], kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        for q in np.unique(bucket).tolist():
            a, z = np.searchsorted(bucket[by], [q, q + 1])
            own = at[slice(*np.searchsorted(bucket[which][at], [q, q + 1]))]
            steps = [np.diff(x, prepend=x.dtype.type(0)) for x in (keys[by[a:z]], (number[which[own]] - a).astype("<i4"), places[own, 0])]
            yield q, packed([digests[by[a:z]], *steps, places[own, 1]])


def later_singles(parts: list, by_key: bool):
    """(batch, packed stretches) of the single windows that start earlier elsewhere; see ``Singles.dealt``."""
    if not parts:
        return
    batch = np.concatenate([np.full(len(x[1]), b, np.int64) for b, x in parts])
    digests, keys = np.concatenate([x[0] for _, x in parts]), np.concatenate([x[1] for _, x in parts])
    by = np.lexsort((batch, keys, *digests.T))
    new = np.ones(len(by), bool)
    new[1:] = (digests[by[1:]] != digests[by[:-1]]).any(1)
    first = by[new][np.cumsum(new) - 1]
    late = np.zeros(len(by), bool)
    late[by] = keys[by] != keys[first] if by_key else by != first
    at = 0
    for b, (_, own, which, row, place) in parts:
        gone = late[at : at + len(own)][which]
        at += len(own)
        if gone.any():
            yield b, packed([x.astype("<i4") for x in stretches(row[gone], place[gone])])


class Batch:
    """The rows of one batch in order of their key and text, as buffers."""

    def __init__(self, rows: pa.Table, scheme):
        rows = rows.combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[("k", "ascending"), ("t", "ascending")], null_placement="at_start")
        rows = rows.take(order).combine_chunks()
        key = rows.column("k")
        self.nulls = key.null_count
        self.keys = key.fill_null(NO_KEY).to_numpy().astype(np.int64)
        column = rows.column("t")
        self.raw, self.at = joined_buffers(column.chunk(0) if column.num_chunks else pa.array([], pa.large_string()))
        self.first, self.units, self.values, self.parts = scheme.read(self.raw, self.at)


class Repeats:
    """The steps above for one scheme of units.

    scheme.k: units in a window; scheme.by_key: a window is earlier only in a row with a smaller key;
    scheme.read(raw, at) -> (first unit of each row, units, each window's
    minimiser, each part's hash); scheme.cutter(raw, units) -> function of (begin, stop) -> the packed string of those units;
    scheme.window_counts(strings) -> windows in each; scheme.later(strings) -> see ``settle``;
    scheme.kept(batch, covered) -> what is left of each row.
    """

    def __init__(self, scheme, frequent: int = 256, batch_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20):
        self.scheme, self.frequent, self.batch_bytes, self.bucket_bytes = scheme, frequent, batch_bytes, bucket_bytes

    def batches(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        total = text_bytes(docs, text)
        self.n_batches = max(64, total // self.batch_bytes)
        self.n_buckets = max(8, total // self.bucket_bytes)
        return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text)), F.lit(self.n_batches)).cast("int").alias("b"))

    def announce(self, batches: DataFrame) -> DataFrame:
        scheme, n = self.scheme, self.n_buckets
        schema = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])

        def f(rows: pa.Table) -> pa.Table:
            b = rows.column("b")[0].as_py()
            batch = Batch(rows, scheme)
            start, windows, value, _ = runs(batch.values, batch.first, scheme.k)
            weight = np.ones(len(value)) if scheme.by_key else weights(start, windows, value, batch.values, batch.parts)
            values, where = np.unique(value, return_inverse=True)
            count = np.bincount(where, weight, len(values)).astype(np.int64)
            bucket = (values % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            values, count, bucket = values[order], count[order], bucket[order]
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            out = [packed([values[i:j], np.minimum(count[i:j], 65535).astype("<u2")]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.table([bucket[cut[:-1]], np.full(len(out), b, np.int32), pa.array(out, pa.binary())], schema=schema)

        return batches.groupBy("b").applyInArrow(f, "bucket int, b int, blob binary")

    def answer(self, announced: DataFrame) -> DataFrame:
        frequent = self.frequent
        schema = pa.schema([("b", pa.int32()), ("blob", pa.binary())])

        def f(rows: pa.Table) -> pa.Table:
            who, got = rows.column("b").to_numpy(), [unpacked(x, ["<u8", "<u2"]) for x in blobs(rows.column("blob"))]
            values = np.concatenate([g[0] for g in got])
            distinct, where = np.unique(values, return_inverse=True)
            total = np.bincount(where, np.concatenate([g[1] for g in got]).astype(float))
            out_b, out, at = [], [], 0
            for b, (v, _) in zip(who.tolist(), got, strict=True):
                n = total[where[at : at + len(v)]]
                at += len(v)
                if (n >= 2).any():
                    out_b.append(b)
                    out.append(packed([v[n >= 2], (n[n >= 2] > frequent).astype("u1")]))
            return pa.table([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], schema=schema)

        return announced.groupBy("bucket").applyInArrow(f, "b int, blob binary")

    def pack(self, batches: DataFrame, answers: DataFrame) -> DataFrame:
        scheme, n, k, by_key = self.scheme, self.n_buckets, self.scheme.k, self.scheme.by_key
        schema = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("strings", pa.binary()), ("singles", pa.binary()), ("later", pa.binary())])

        def f(rows: pa.Table, said: pa.Table) -> pa.Table:
            empty = schema.empty_table()
            if not len(rows) or not len(said):
                return empty
            b = rows.column("b")[0].as_py()
            known = [unpacked(x, ["<u8", "u1"]) for x in blobs(said.column("blob"))]
            repeated = np.concatenate([x[0] for x in known])
            order = np.argsort(repeated)
            repeated, often = repeated[order], np.concatenate([x[1] for x in known])[order]
            batch = Batch(rows, scheme)
            start, windows, value, row = runs(batch.values, batch.first, k)
            at = np.minimum(np.searchsorted(repeated, value), len(repeated) - 1)
            keep = np.flatnonzero(repeated[at] == value)
            start, windows, value, row, often = start[keep], windows[keep], value[keep], row[keep], often[at[keep]]
            local = start - batch.first[row]
            bucket = (value % np.uint64(n)).astype(np.int64)
            # rows go by key and runs by their place, so the first of equal strings is the earliest
            seen: dict = {}
            later, out, single = [], {}, Singles(by_key)
            keys = batch.keys.tolist()
            cut = scheme.cutter(batch.raw, batch.units)
            for i, (s, w, many, r, p, q) in enumerate(zip(start.tolist(), windows.tolist(), often.tolist(), row.tolist(), local.tolist(), bucket.tolist(), strict=True)):
                string = cut(s, s + w + k - 1)
                if seen.setdefault(string, keys[r] if by_key else i) != (keys[r] if by_key else i):
                    later.append(i)
                elif many:
                    for j in range(w):
                        single.add(cut(s + j, s + j + k), keys[r], r, p + j)
                else:
                    out.setdefault(q, []).append((string, r, p))
            found = []
            for q, items in out.items():
                strings, r, p = zip(*items, strict=True)
                r = np.array(r, np.int32)
                found.append((q, packed([np.array([len(s) for s in strings], "<i4"), np.frombuffer(b"".join(strings), "u1"), batch.keys[r], r, np.array(p, "<i4")]), None, None))
            found += [(q, None, blob, None) for q, blob in single.dealt(n)]
            i = np.array(later, np.int64)
            late = [np.concatenate([x.astype(np.int64), y]) for x, y in zip((row[i], local[i], windows[i]), stretches(*single.later()), strict=True)]
            if len(late[0]):
                found.append((b % n, None, None, packed([x.astype("<i4") for x in late])))
            if not found:
                return empty
            q, *columns = zip(*found, strict=True)
            return pa.table([pa.array(q, pa.int32()), pa.array([b] * len(q), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], schema=schema)

        return batches.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(f, "bucket int, b int, strings binary, singles binary, later binary")

    def settle(self, packs: DataFrame) -> DataFrame:
        """scheme.later(strings, keys) gets packed strings in order of their occurrence, and the keys of their
        rows, and returns (string, first window, windows) of the windows that also start earlier."""
        scheme = self.scheme
        schema = pa.schema([("b", pa.int32()), ("blob", pa.binary())])

        def f(rows: pa.Table) -> pa.Table:
            out_b, out, parts, singles = [], [], [], []
            for b, strings, single, late in zip(*(rows.column(c).to_pylist() for c in ("b", "strings", "singles", "later")), strict=True):
                if late is not None:
                    out_b.append(b)
                    out.append(late)
                if single is not None:
                    digests, *steps, place = unpacked(single, ["<u4", "<i8", "<i4", "<i4", "<i4"])
                    singles.append((b, [digests.reshape(-1, 3), *(np.cumsum(x, dtype=x.dtype) for x in steps), place]))
                if strings is not None:
                    parts.append((b, unpacked(strings, ["<i4", "u1", "<i8", "<i4", "<i4"])))
            if parts:
                batch = np.concatenate([np.full(len(x[0]), b, np.int32) for b, x in parts])
                length, data, keys, row, place = (np.concatenate([x[i] for _, x in parts]) for i in range(5))
                end = np.cumsum(length, dtype=np.int64)
                order = np.lexsort((place, row, batch, keys))
                raw, seen, kept, late = data.tobytes(), {}, [], []
                same = keys if scheme.by_key else np.arange(len(keys))
                for i, who, s, e in zip(order.tolist(), same[order].tolist(), (end - length)[order].tolist(), end[order].tolist(), strict=True):
                    (kept if seen.setdefault(raw[s:e], who) == who else late).append(i)
                kept, late = np.array(kept, np.int64), np.array(late, np.int64)
                strings = [raw[s:e] for s, e in zip((end - length)[kept].tolist(), end[kept].tolist(), strict=True)]
                del data, seen
                which, offset, windows = scheme.later(strings, keys[kept])
                # all windows of a string that another equals start later
                whole = scheme.window_counts([raw[s:e] for s, e in zip((end - length)[late].tolist(), end[late].tolist(), strict=True)])
                i = np.concatenate([kept[which], late])
                place_at = np.concatenate([place[kept[which]] + offset, place[late]])
                many = np.concatenate([windows, whole])
                by = np.argsort(batch[i], kind="stable")
                i, place_at, many = i[by], place_at[by], many[by]
                cut = np.append(np.flatnonzero(np.diff(batch[i], prepend=-1)), len(i))
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    out_b.append(int(batch[i[a]]))
                    out.append(packed([row[i[a:z]], place_at[a:z].astype("<i4"), many[a:z].astype("<i4")]))
            for b, late in later_singles(singles, scheme.by_key):
                out_b.append(b)
                out.append(late)
            return pa.table([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], schema=schema)

        return packs.groupBy("bucket").applyInArrow(f, "b int, blob binary")

    def remove(self, batches: DataFrame, found: DataFrame) -> DataFrame:
        scheme, k = self.scheme, self.scheme.k
        span = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
        schema = pa.schema([("k", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

        def f(rows: pa.Table, said: pa.Table) -> pa.Table:
            if not len(rows):
                return schema.empty_table()
            batch = Batch(rows, scheme)
            total = int(batch.first[-1])
            edge = np.zeros(total + 1, np.int32)
            for blob in blobs(said.column("blob")):
                row, place, windows = (x.astype(np.int64) for x in unpacked(blob, ["<i4", "<i4", "<i4"]))
                begin = batch.first[row] + place
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + windows + k - 1, -1)
            covered = np.cumsum(edge[:-1]) > 0
            # spans end at the end of their row
            change = np.zeros(total + 1, bool)
            if total:
                change[1:-1] = covered[1:] != covered[:-1]
            change[batch.first] = True
            at = np.flatnonzero(change)
            at = at[at < total]
            stop = np.append(at[1:], total)
            on = covered[at] if total else np.zeros(0, bool)
            at, stop = at[on], stop[on]
            owner = np.searchsorted(batch.first, at, side="right") - 1
            n = len(batch.keys)
            per_row = np.searchsorted(owner, np.arange(n + 1))
            spans = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays([pa.array((at - batch.first[owner]).astype(np.int32)), pa.array((stop - batch.first[owner]).astype(np.int32))], ["begin", "stop"]))
            gone = np.bincount(owner, stop - at, n).astype(np.int64)
            keys = pa.array(batch.keys, mask=np.arange(n) < batch.nulls)
            return pa.table([keys, pa.array(np.diff(batch.first)), pa.array(gone), spans, pa.array(scheme.kept(batch, covered), pa.binary())], schema=schema)

        return batches.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(f, "k long, n_units long, n_removed long, spans array<struct<begin int, stop int>>, kept binary")

    def run(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        batches = self.batches(docs, key, text)
        answers = self.answer(self.announce(batches))
        return self.remove(batches, self.settle(self.pack(batches, answers)))
