"""N-gram Jaccard self-join: a size-aware heavy-light join over sets of word shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, joined_buffers, mixed, released, saved, swept, word_hashes, word_spans
from .components import components, joined
from .repeats import blobs, packed, unpacked

#: An entity is its batch and its place there: batch * PLACES + place.
PLACES = 1 << 24
#: A signature that so many sets have is one of a frequent shingle.
LONG_LIST = 16
#: Kinds of the columns of entries: signature, place, size, rest; and of each different place its set's bitmap.
ENTRIES = ["<u8", "<i4", "<i4", "<i4", "<i4", "<u8"]
#: Kinds of the columns of crossing entries: signature, entity, size, rest, root; and of each entity its bitmap.
CROSSING = ["<u8", "<i8", "<i4", "<i4", "<i8", "<i8", "<u8"]
#: 64-bit numbers of a set's bitmap.
LANES = 16
#: Shingles that a task remembers while it checks pairs.
KNOWN = 1 << 22


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted. Of fewer words than ``width``, all together are one shingle."""
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    start, end, first = word_spans(lower, at)
    hashes = word_hashes(lower, start, end)
    n = max(0, len(hashes) - width + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        grams += hashes[j : j + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1)
    grams = mixed(grams)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(grams[a : z - width + 1]))
        else:
            whole = hashlib.blake2b(hashes[a:z].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64) if z > a else np.zeros(0, np.uint64))
    return out


def offsets_of(length: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(length, dtype=np.int64)])


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each hash of a set, by its highest bits."""
    bits = np.zeros(64 * LANES, bool)
    bits[found >> np.uint64(64 - (64 * LANES).bit_length() + 1)] = True
    return np.packbits(bits).view("<u8")


class Bitmaps:
    """The bitmaps and sizes of some entities; ``link`` tells which pairs may link by them.

    A bit that only one set has stands for a shingle that only it has, so what two sets share is at most either
    size less such bits. Pairs that link always pass.
    """

    def __init__(self, e: np.ndarray, size: np.ndarray, node: np.ndarray, bits: np.ndarray, percent: int):
        self.node, first = np.unique(node, return_index=True)
        self.bits, self.percent = bits.reshape(-1, LANES)[first], percent
        self.ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.size = np.zeros(len(self.node), np.int64)
        self.size[np.searchsorted(self.node, e)] = size

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 13):
            x, y = np.searchsorted(self.node, a[i : i + (1 << 13)]), np.searchsorted(self.node, b[i : i + (1 << 13)])
            both = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64)
            most = both + np.minimum(self.size[x] - self.ones[x], self.size[y] - self.ones[y])
            out[i : i + len(x)] = (100 + self.percent) * most >= self.percent * (self.size[x] + self.size[y])
        return out


def least_overlap(size: int, percent: int) -> int:
    """What a set of ``size`` shares at least with any set it links to."""
    return -(-percent * size // 100)


def signatures(found: np.ndarray, rank: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set: hashes of which it shares one with every different set that it links to, and their rests.

    ``rank`` orders the set's shingles, rare ones first, alike for all sets. Two linked sets of size up to
    ``boundary`` share two shingles of their prefixes one longer than needed for one: the light scheme takes
    all pairs of it. A set that may link to one above the boundary, or is above it, takes the shingles of
    its prefix as they are: the heavy scheme, scanned as inverted lists. A rest bounds what sets can share
    whose first common signature it is: the signature's own shingles and all later ones in order.
    """
    size = len(found)
    need = least_overlap(size, percent)
    if size < 4:  # sets this small link only to equal ones
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    prefix = found[np.lexsort((found, rank))][: size - need + 2]
    sig, rest = [], []
    if 100 * size > percent * boundary:
        sig.append(mixed(prefix[: size - need + 1]))
        rest.append(size - np.arange(size - need + 1))
    if size <= boundary:
        i, j = np.triu_indices(len(prefix), 1)
        sig.append(mixed(np.minimum(prefix[i], prefix[j]) * np.uint64(3) + np.maximum(prefix[i], prefix[j])))
        rest.append(size - j + 1)
    return np.concatenate(sig), np.concatenate(rest).astype(np.int32)


def may_link(size_a, rest_a, size_b, rest_b, percent: int):
    """Whether sets that share a signature can still share enough, by their sizes and rests."""
    return (100 + percent) * np.minimum(rest_a, rest_b).astype(np.int64) >= percent * (size_a.astype(np.int64) + size_b)


def cheapest_boundary(histogram: list[tuple[int, int]], percent: int, scan: float) -> int:
    """The size up to which enumerating pairs costs less than scanning lists, from (size, sets) counts.

    A pair signature costs 1. A list entry costs 1 and the scan of its list, ``scan`` on average.
    """
    best = (float("inf"), 0)
    for boundary in (0, *range(8, 129, 4)):
        cost = 0.0
        for size, n in histogram:
            p = size - least_overlap(size, percent) + 1
            if 100 * size > percent * boundary:
                cost += n * p * (1 + scan)
            if size <= boundary:
                cost += n * p * (p + 1) / 2
        best = min(best, (cost, boundary))
    return best[1]


class Join:
    """One self-join of documents; see ``classes``.

    Texts are packed once into batches of about ``batch_bytes``, one compressed row each, in the shared folder;
    what reads them again needs no shuffle. An entity is the first row of a batch with its set.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, batch_bytes: int = 4 << 20, batches_a_bucket: int = 8, scan: float = 4.0, most_frequent: int = 1 << 17):
        self.width, self.percent, self.scan, self.most_frequent = width, percent, scan, most_frequent
        self.spark = docs.sparkSession

        def pack(rows):
            base, seq, keys, nulls, texts, size = TaskContext.get().partitionId() << 16, 0, [], [], [], 0

            def done():
                length = np.array([len(t) for t in texts], "<i4")
                blob = packed([np.array(keys, "<i8"), np.array(nulls, "u1"), length, np.frombuffer(b"".join(texts), np.uint8)])
                return pa.RecordBatch.from_arrays([pa.array([base + seq]), pa.array([blob], pa.binary())], ["b", "blob"])

            for batch in rows:
                raw, at = joined_buffers(batch.column(1))
                data = raw.tobytes()
                for k, a, z in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    keys.append(0 if k is None else k)
                    nulls.append(k is None)
                    texts.append(data[a:z])
                    size += z - a
                    if size >= batch_bytes or len(keys) == PLACES - 1:
                        yield done()
                        seq, keys, nulls, texts, size = seq + 1, [], [], [], 0
            if keys:
                yield done()

        self.batches = saved(docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(pack, "b long, blob binary"))
        self.n_buckets = max(64, self.batches.count() // batches_a_bucket)

    def sets(self) -> DataFrame:
        """(e, own, k, n, d1, d2, frequent): each row's entity, whether it is the row itself, key, set size and
        128-bit digest of its set; one row of each batch also carries the shingles that two or more of the
        batch's different sets hold."""
        width = self.width

        def f(rows):
            for batch in rows:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys, nulls, length, raw = unpacked(blob, ["<i8", "u1", "<i4", "u1"])
                    found = shingle_sets(raw, offsets_of(length), width)
                    d = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found), np.int64).reshape(-1, 2)
                    _, one, same = np.unique(d, axis=0, return_index=True, return_inverse=True)
                    values, count = np.unique(np.concatenate([found[i] for i in one]), return_counts=True)
                    often = [None] * len(found)
                    often[0] = packed([values[count > 1], count[count > 1].astype("<i4")])
                    first = one[same.reshape(-1)]
                    yield pa.RecordBatch.from_arrays([pa.array(first + b * PLACES), pa.array(first == np.arange(len(first))), pa.array(keys, mask=nulls.astype(bool)), pa.array([len(s) for s in found], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(often, pa.binary())], ["e", "own", "k", "n", "d1", "d2", "frequent"])
            released()

        return self.batches.mapInArrow(f, "e long, own boolean, k long, n long, d1 long, d2 long, frequent binary")

    def frequent(self, sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles by what the batches saw, at most ``most_frequent``, as (mixed hash, count).

        They come last in the order. Only speed depends on it: any order that all sets share finds every link.
        """

        def split(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    values, count = unpacked(blob, ["<u8", "<i4"])
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "c"])

        seen = sets.where("frequent IS NOT NULL").select("frequent").mapInArrow(split, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 8")
        top = seen.orderBy(F.col("c").desc(), "h").limit(self.most_frequent).toArrow()
        values, count = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
        return ranks_of(mixed(values), count)

    def ranks(self, sets: DataFrame, boundary: int):
        """The order of shingles: (mixed hash, rank), for those that come last, the most frequent at the end.

        What several sets of a batch share comes from ``frequent``. Under that order the prefixes' lists are
        counted once, and shingles with long lists come last too: passages too rare to be seen in one batch.
        """
        n, most = self.n_buckets, self.most_frequent
        values, count = self.frequent(sets)

        def count_lists(batches):
            for batch in batches:
                for blob in batch.column(1).to_pylist():
                    sig, many = np.unique(unpacked(blob, ENTRIES)[0], return_counts=True)
                    bucket = (sig % np.uint64(n)).astype(np.int32)
                    by = np.argsort(bucket, kind="stable")
                    cut = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by))
                    out = [packed([sig[by[i:j]], many[by[i:j]].astype("<i4")]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[by[cut[:-1]]]), pa.array(out, pa.binary())], ["bucket", "blob"])
            released()

        schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

        def long_lists(rows: pa.Table) -> pa.Table:
            got = [unpacked(x, ["<u8", "<i4"]) for x in blobs(rows.column("blob"))]
            sig, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            total = np.bincount(where, np.concatenate([g[1] for g in got]).astype(float), len(sig)).astype(np.int64)
            return pa.table([sig[total >= LONG_LIST].view(np.int64), total[total >= LONG_LIST]], schema=schema)

        first = self.spark.sparkContext.broadcast((values, count))
        lists = self.entries(first, boundary).mapInArrow(count_lists, "bucket int, blob binary").groupBy("bucket").applyInArrow(long_lists, "h long, c long")
        top = lists.orderBy(F.col("c").desc(), "h").limit(most).toArrow()
        return self.spark.sparkContext.broadcast(ranks_of(np.concatenate([values, top.column("h").to_numpy().view(np.uint64)]), np.concatenate([count, top.column("c").to_numpy()])))

    def entries(self, frequent, boundary: int) -> DataFrame:
        """(b, blob): the signatures of each batch's entities; see ENTRIES."""
        width, percent = self.width, self.percent

        def f(rows):
            values, count = frequent.value
            for batch in rows:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    _, _, length, raw = unpacked(blob, ["<i8", "u1", "<i4", "u1"])
                    sig, owner, size, rest, place, bits, seen = [], [], [], [], [], [], set()
                    for i, s in enumerate(shingle_sets(raw, offsets_of(length), width)):
                        if len(s) < 4 or (mark := s.tobytes()) in seen:
                            continue
                        seen.add(mark)
                        rank = np.zeros(len(s), np.int64)
                        if len(values):
                            m = mixed(s)
                            where = np.minimum(np.searchsorted(values, m), len(values) - 1)
                            rank = np.where(values[where] == m, count[where], 0)
                        got, left = signatures(s, rank, percent, boundary)
                        sig.append(got)
                        rest.append(left)
                        owner.append(np.full(len(sig[-1]), i, np.int32))
                        size.append(np.full(len(sig[-1]), len(s), np.int32))
                        place.append(i)
                        bits.append(bitmap(s))
                    if sig:
                        columns = [*(np.concatenate(x) for x in (sig, owner, size, rest)), np.array(place, "<i4"), np.concatenate(bits)]
                        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([packed(columns)], pa.binary())], ["b", "blob"])
            released()

        return self.batches.mapInArrow(f, "b long, blob binary")

    def stars(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, c) of each signature's first set with the others that may link to it, c times; and the
        signatures (b, shared) of each batch that other batches have too, with the least size there is.

        Within a batch at once; then only the first of each batch goes to the signature's bucket, so that a
        bucket gets a signature at most once from a batch.
        """
        n, percent = self.n_buckets, self.percent

        def each(batches):
            for batch in batches:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sig, owner, size, rest, place, bits = unpacked(blob, ENTRIES)
                    e = owner.astype(np.int64) + b * PLACES
                    yield sig, e, size, rest, place.astype(np.int64) + b * PLACES, bits

        def near(batches):
            for sig, e, size, rest, node, bits in each(batches):
                _, pairs = star(sig, e, size, rest, percent)
                keep = Bitmaps(e, size, node, bits, percent).link(pairs[0], pairs[1])
                yield pa.RecordBatch.from_arrays([pa.array([packed([x[keep] for x in pairs])], pa.binary())], ["blob"])

        def firsts(batches):
            for sig, e, size, rest, _, _ in each(batches):
                head, _ = star(sig, e, size, rest, percent)
                # for a batch's entries of one signature: the least size and the largest rest
                _, where = np.unique(sig, return_inverse=True)
                least, most = np.full(len(head), np.iinfo(np.int32).max, np.int32), np.zeros(len(head), np.int32)
                np.minimum.at(least, where, size)
                np.maximum.at(most, where, rest)
                bucket, out = (sig[head] % np.uint64(n)).astype(np.int32), []
                by = np.argsort(bucket, kind="stable")
                cut = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by))
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    at = head[by[i:j]]
                    out.append((int(bucket[by[i]]), packed([sig[at], e[at], size[at], rest[at], least[by[i:j]], most[by[i:j]]])))
                q, x = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(x, pa.binary())], ["bucket", "blob"])
            released()

        def across(rows: pa.Table) -> pa.Table:
            got = [unpacked(x, ["<u8", "<i8", "<i4", "<i4", "<i4", "<i4"]) for x in blobs(rows.column("blob"))]
            sig, e, size, rest, least, most = (np.concatenate(x) for x in zip(*got, strict=True))
            out = [(None, packed(star(sig, e, size, rest, percent)[1]))]
            _, where, count = np.unique(sig, return_inverse=True, return_counts=True)
            low = np.full(len(count), np.iinfo(np.int32).max, np.int32)
            np.minimum.at(low, where, least)
            low = low[where]
            again = (count[where] > 1) & hopeful(least, most, low, percent)
            sig, low, batch = sig[again], low[again], e[again] // PLACES
            by = np.argsort(batch, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(batch[by], prepend=-1)), len(by))
            out += [(int(batch[by[i]]), packed([sig[by[i:j]], low[by[i:j]]])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            q, x = zip(*out, strict=True)
            return pa.table([pa.array(q, pa.int64()), pa.array(x, pa.binary())], schema=pa.schema([("b", pa.int64()), ("shared", pa.binary())]))

        far = swept(entries.mapInArrow(firsts, "bucket int, blob binary").groupBy("bucket").applyInArrow(across, "b long, shared binary"))
        pairs = entries.mapInArrow(near, "blob binary").unionByName(far.where("b IS NULL").select(F.col("shared").alias("blob")))
        return swept(rows_of(pairs, counted=True)), far.where("b IS NOT NULL")

    def shared(self, entries: DataFrame, answers: DataFrame) -> DataFrame:
        """The entries whose signature another one has with which they may link."""
        percent = self.percent
        schema = pa.schema([("b", pa.int64()), ("blob", pa.binary())])

        def narrow(rows: pa.Table, said: pa.Table) -> pa.Table:
            if not len(rows):
                return schema.empty_table()
            *all_, place, bits = unpacked(rows.column("blob")[0].as_py(), ENTRIES)
            sig, where, count = np.unique(all_[0], return_inverse=True, return_counts=True)
            low = np.full(len(sig), np.iinfo(np.int32).max, np.int32)
            np.minimum.at(low, where, all_[2])
            low[count < 2] = np.iinfo(np.int32).max
            for x in blobs(said.column("shared")) if len(said) else ():
                other, least = unpacked(x, ["<u8", "<i4"])
                at = np.searchsorted(sig, other)
                low[at] = np.minimum(low[at], least)
            low = low[where]
            keep = (low < np.iinfo(np.int32).max) & hopeful(all_[2], all_[3], low, percent)
            left = np.isin(place, all_[1][keep])
            return pa.table([rows.column("b"), pa.array([packed([*(x[keep] for x in all_), place[left], bits.reshape(-1, LANES)[left]])], pa.binary())], schema=schema)

        return entries.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(narrow, "b long, blob binary")

    def texts(self, entries: DataFrame) -> DataFrame:
        """(e, t): the compressed texts of the sets that have an entry left."""
        schema = pa.schema([("e", pa.int64()), ("t", pa.binary())])

        def cut(rows: pa.Table, said: pa.Table) -> pa.Table:
            place = np.unique(np.concatenate([unpacked(x, ENTRIES)[1] for x in blobs(said.column("blob"))])) if len(said) else []
            if not len(rows) or not len(place):
                return schema.empty_table()
            _, _, length, raw = unpacked(rows.column("blob")[0].as_py(), ["<i8", "u1", "<i4", "u1"])
            at, b = offsets_of(length), rows.column("b")[0].as_py()
            return pa.table([pa.array(place.astype(np.int64) + b * PLACES), pa.array([packed([raw[at[i] : at[i + 1]]]) for i in place], pa.binary())], schema=schema)

        return self.batches.groupBy("b").cogroup(entries.groupBy("b")).applyInArrow(cut, "e long, t binary")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs whose sets link, in few partitions; pairs are stored already."""
        width, percent = self.width, self.percent

        def check(batches):
            known, held = {}, 0

            def found(e, blob):
                nonlocal held
                if e not in known:
                    (raw,) = unpacked(blob.as_py(), ["u1"])
                    s = shingle_sets(raw, np.array([0, len(raw)]), width)[0]
                    if held + len(s) > KNOWN:
                        known.clear()
                        held = 0
                    known[e] = s
                    held += len(s)
                return known[e]

            for batch in batches:
                a, b = (c.to_pylist() for c in batch.columns[:2])
                ta, tb = batch.columns[2:]
                keep = []
                for i in range(len(a)):
                    x, y = found(a[i], ta[i]), found(b[i], tb[i])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])
            released()

        one = pairs.join(texts.select(F.col("e").alias("a"), F.col("t").alias("ta")).hint("merge"), "a")
        two = one.join(texts.select(F.col("e").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
        return two.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").repartition(1 + pairs.count() // FILE_ROWS)

    def crossing(self, entries: DataFrame, names: DataFrame) -> DataFrame:
        """(bucket, b, blob): the entries of signatures whose sets aren't in one component yet.

        names: (e, rep, root) of the entities that another represents or that are in a component.

        Batches first tell the buckets the least and largest component of each signature; signatures with one
        component are done. Of the others all sets go to the bucket.
        """
        n, percent = self.n_buckets, self.percent
        named = names.withColumn("b", F.floor(F.col("e") / F.lit(PLACES)).cast("long"))

        def of(rows: pa.Table, said: pa.Table):
            b = rows.column("b")[0].as_py()
            sig, owner, size, rest, place, bits = unpacked(rows.column("blob")[0].as_py(), ENTRIES)
            e = owner.astype(np.int64) + b * PLACES
            rep, root = e.copy(), e.copy()
            if len(said):
                node = said.column("e").to_numpy()
                by = np.argsort(node)
                node = node[by]
                at = np.minimum(np.searchsorted(node, e), len(node) - 1)
                rep, root = (np.where(node[at] == e, said.column(c).to_numpy()[by][at], e) for c in ("rep", "root"))
            return (b, sig, rep, size, rest, root), bits.reshape(-1, LANES)[np.searchsorted(place, owner)]

        told = pa.schema([("bucket", pa.int32()), ("b", pa.int64()), ("blob", pa.binary())])

        def spread(b, bucket, arrays, bits=None) -> pa.Table:
            by = np.argsort(bucket, kind="stable")
            cut, out = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by)), []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                columns = [x[by[i:j]] for x in arrays]
                if bits is not None:
                    node, one = np.unique(columns[1], return_index=True)
                    columns += [node, bits[by[i:j][one]]]
                out.append(packed(columns))
            return pa.table([pa.array(bucket[by[cut[:-1]]].astype(np.int32)), pa.array([b] * len(out), pa.int64()), pa.array(out, pa.binary())], schema=told)

        def announce(rows: pa.Table, said: pa.Table) -> pa.Table:
            if not len(rows):
                return told.empty_table()
            (b, sig, _, _, _, root), _ = of(rows, said)
            if not len(sig):
                return told.empty_table()
            by = np.lexsort((root, sig))
            sig, root = sig[by], root[by]
            cut = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
            return spread(b, (sig[cut[:-1]] % np.uint64(n)).astype(np.int64), [sig[cut[:-1]], root[cut[:-1]], root[cut[1:] - 1]])

        answered = pa.schema([("b", pa.int64()), ("mixed", pa.binary())])

        def answer(rows: pa.Table) -> pa.Table:
            got = [unpacked(x, ["<u8", "<i8", "<i8"]) for x in blobs(rows.column("blob"))]
            sig, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            low, high = np.full(len(sig), np.iinfo(np.int64).max), np.full(len(sig), -1)
            np.minimum.at(low, where, np.concatenate([g[1] for g in got]))
            np.maximum.at(high, where, np.concatenate([g[2] for g in got]))
            out, at = [], 0
            for b, g in zip(rows.column("b").to_pylist(), got, strict=True):
                mix = (low < high)[where[at : at + len(g[0])]]
                at += len(g[0])
                if mix.any():
                    out.append((b, packed([g[0][mix]])))
            q, x = zip(*out, strict=True) if out else ((), ())
            return pa.table([pa.array(q, pa.int64()), pa.array(x, pa.binary())], schema=answered)

        def send(rows: pa.Table, said: pa.Table) -> pa.Table:
            mix = [unpacked(x, ["<u8"])[0] for x in blobs(said.column("mixed"))] if len(said) else []
            if not len(rows) or not mix:
                return told.empty_table()
            (b, *of_each), bits = of(rows, said.filter(pc.is_valid(said.column("e"))))
            keep = np.isin(of_each[0], np.concatenate(mix))
            of_each = [x[keep] for x in of_each]
            return spread(b, (of_each[0] % np.uint64(n)).astype(np.int64), of_each, bits[keep])

        kind = "bucket int, b long, blob binary"
        announced = entries.groupBy("b").cogroup(named.groupBy("b")).applyInArrow(announce, kind)
        mixed_ = announced.groupBy("bucket").applyInArrow(answer, "b long, mixed binary")
        nothing = [F.lit(None).cast("long").alias(c) for c in ("e", "rep", "root")]
        said = named.select("b", "e", "rep", "root", F.lit(None).cast("binary").alias("mixed")).unionByName(mixed_.select("b", *nothing, "mixed"))
        return entries.groupBy("b").cogroup(said.groupBy("b")).applyInArrow(send, kind)

    def many(self, crossing: DataFrame, each: int = 4) -> bool:
        """Whether the pairs of crossing entries are more than ``each`` for a set; the count ends there."""
        percent, schema = self.percent, pa.schema([("sets", pa.int64()), ("pairs", pa.int64())])

        def count(rows: pa.Table) -> pa.Table:
            columns, maps = crossing_of(rows, percent)
            sets = len(maps.node)
            return pa.table([[sets], [len(unlike(*columns, maps, percent, each * sets)[0])]], schema=schema)

        r = crossing.groupBy("bucket").applyInArrow(count, "sets long, pairs long").agg(F.sum("sets").alias("n"), F.sum("pairs").alias("pairs")).first()
        return (r["pairs"] or 0) > each // 2 * (r["n"] or 0)

    def pairs(self, crossing: DataFrame, seed: int | None = None) -> DataFrame:
        """All pairs of one signature that may link and aren't in one component yet.

        With a seed only some: each entry with one that follows it in an order by the seed.
        """
        percent = self.percent

        def pair(rows: pa.Table) -> pa.Table:
            columns, maps = crossing_of(rows, percent)
            found = unlike(*columns, maps, percent) if seed is None else some_unlike(*columns, maps, percent, seed)
            return pa.table([[packed(found)]], schema=pa.schema([("blob", pa.binary())]))

        return rows_of(crossing.groupBy("bucket").applyInArrow(pair, "blob binary"))


def ranks_of(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, each with its largest count."""
    out, where = np.unique(values, return_inverse=True)
    most = np.zeros(len(out), np.int64)
    np.maximum.at(most, where, count)
    return out, most


def hopeful(size: np.ndarray, rest: np.ndarray, low: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries may link to others of their signature of which the smallest has size ``low``."""
    size = size.astype(np.int64)
    return (100 + percent) * rest.astype(np.int64) >= percent * (size + np.maximum(low, -(-percent * size // 100)))


def star(sig: np.ndarray, e: np.ndarray, size: np.ndarray, rest: np.ndarray, percent: int):
    """(place of each signature's first entity, [a, b, how often] of the pairs with it that sizes and rests allow)."""
    by = np.lexsort((e, sig))
    new = np.concatenate([[True], sig[by][1:] != sig[by][:-1]]) if len(by) else np.zeros(0, bool)
    head = by[new]
    first = head[np.cumsum(new) - 1] if len(by) else by
    keep = (e[by] != e[first]) & may_link(size[by], rest[by], size[first], rest[first], percent)
    pairs, count = np.unique(np.stack([e[first][keep], e[by][keep]], 1), axis=0, return_counts=True)
    return head, [pairs[:, 0], pairs[:, 1], count.astype(np.int64)]


def crossing_of(rows: pa.Table, percent: int):
    """The columns of a bucket's crossing entries, and the bitmaps of their entities."""
    got = [unpacked(x, CROSSING) for x in blobs(rows.column("blob"))]
    *columns, node, bits = (np.concatenate(x) for x in zip(*got, strict=True))
    return columns, Bitmaps(columns[1], columns[2], node, bits, percent)


def some_unlike(sig, e, size, rest, root, maps: Bitmaps, percent: int, seed: int, reach: int = 8):
    """[a, b] of half of the entries, by the seed, each with the first of up to ``reach`` that follow it and
    that ``unlike`` would pair with it."""
    by = np.lexsort((mixed(e.astype(np.uint64) ^ mixed(np.array([seed], np.uint64))), sig))
    sig, e, size, rest, root = (x[by] for x in (sig, e, size.astype(np.int64), rest, root))
    out, live = [], np.flatnonzero(mixed(sig ^ mixed(e.astype(np.uint64) + np.uint64(seed))) % np.uint64(2) == 0)
    for step in range(1, reach + 1):
        live = live[live + step < len(sig)]
        live = live[sig[live] == sig[live + step]]
        other = live + step
        low, high = np.minimum(size[live], size[other]), np.maximum(size[live], size[other])
        keep = (root[live] != root[other]) & (100 * low >= percent * high) & may_link(size[live], rest[live], size[other], rest[other], percent)
        keep[keep] = maps.link(e[live[keep]], e[other[keep]])
        out.append(np.stack([np.minimum(e[live], e[other]), np.maximum(e[live], e[other])], 1)[keep])
        live = live[~keep]
    pairs = np.unique(np.concatenate(out), axis=0)
    return [pairs[:, 0], pairs[:, 1]]


def unlike(sig, e, size, rest, root, maps: Bitmaps, percent: int, limit: int | None = None):
    """[a, b] of all pairs of one signature in different components that sizes, rests and bitmaps allow.

    With a limit the search ends once it has more, for a count.
    """
    by = np.lexsort((e, size, sig))
    sig, e, size, rest, root = sig[by], e[by], size[by].astype(np.int64), rest[by], root[by]
    end = np.searchsorted(sig, sig, side="right")
    pairs, out, step, live = np.zeros((0, 2), np.int64), [], 1, np.arange(len(sig))
    while True:
        live = live[live + step < end[live]]
        live = live[100 * size[live] >= percent * size[live + step]]  # sizes ascend, so further ones are larger still
        other = live + step
        keep = (root[live] != root[other]) & may_link(size[live], rest[live], size[other], rest[other], percent)
        out.append(np.stack([np.minimum(e[live], e[other]), np.maximum(e[live], e[other])], 1)[keep])
        step += 1
        if not len(live) or sum(map(len, out)) > (1 << 20 if limit is None else 1 << 16):
            new = np.unique(np.concatenate(out), axis=0)
            pairs, out = np.unique(np.concatenate([pairs, new[maps.link(new[:, 0], new[:, 1])]]), axis=0), []
            if not len(live) or limit is not None and len(pairs) > limit:
                return [pairs[:, 0], pairs[:, 1]]


def rows_of(pairs: DataFrame, counted: bool = False) -> DataFrame:
    """Packed pairs as distinct rows (a, b), or (a, b, c) with their counts added up."""
    names = ["a", "b", "c"] if counted else ["a", "b"]

    def split(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpacked(blob, ["<i8"] * len(names))], names)
        released()

    rows = pairs.mapInArrow(split, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("a", "b").agg(F.sum("c").alias("c")) if counted else rows.distinct()


def classes(docs: DataFrame, key: str = "doc_id", rounds: int = 8, **how) -> DataFrame:
    """Each row's set size and the least key that it reaches by links: key, n_shingles, component_id.

    Words are lower-cased (A-Z); a set is the distinct ``width``-word shingles, or the whole of fewer words;
    two sets link when they share ``percent`` of their union. Null, empty and wordless texts have no set and
    are alone. Rows with equal sets are one class. A null key is never least where its component has
    another, and an alone null key has a null component. Other columns are not read; an empty table gives
    no rows.

    Shingles are compared by 64-bit hashes, classes by 128-bit digests. First the pairs of each signature's
    first set are checked and joined to components; then all pairs that cross components are, so no link
    between different components is lost. In between, at most ``rounds`` rounds of chance pairs keep a large
    group of near copies from being spread into all its pairs.
    """
    join = Join(docs, key, **how)
    sets = swept(join.sets())
    reps = sets.where("own AND n > 0").groupBy("d1", "d2").agg(F.min("e").alias("rep"), F.max("n").alias("n"))
    log = F.floor(F.log(F.col("n")) / F.lit(0.05))
    histogram = [(int(r["n"]), r["c"]) for r in reps.groupBy(log.alias("bin")).agg(F.avg("n").alias("n"), F.count("*").alias("c")).collect()]
    boundary = cheapest_boundary(histogram, join.percent, join.scan)
    entries = swept(join.entries(join.ranks(sets, boundary), boundary))
    # equal sets of different batches count as one entity from here on
    names = swept(sets.where("own AND n > 0").select("e", "d1", "d2").join(reps.select("d1", "d2", "rep").hint("merge"), ["d1", "d2"]).select("e", "rep"))
    canon, n = names.where("e <> rep"), names.count()

    stars, answers = join.stars(entries)
    pairs = stars
    for side in ("a", "b"):
        pairs = pairs.join(canon.select(F.col("e").alias(side), F.col("rep").alias("r")).hint("merge"), side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
    pairs = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("c").alias("c"))
    entries = swept(join.shared(entries, answers))
    texts = swept(join.texts(entries))
    join.batches = answers = stars = None  # their files can go

    def two(pairs: DataFrame, first, second) -> DataFrame:
        """Of each set's pairs with earlier ones two at most."""
        each = pairs.groupBy("b").agg(F.array(first, second).alias("a"))
        return each.select(F.explode(F.array_distinct("a")).alias("a"), "b")

    def placed(roots: DataFrame) -> DataFrame:
        named = roots.select(F.col("node").alias("rep"), "root").hint("merge")
        return saved(names.join(named, "rep", "left").select("e", "rep", F.coalesce("root", "rep").alias("root")), n)

    # at first each set asks the one with which it shares most signatures, and the first of all
    asked = swept(two(pairs.join(texts.select(F.col("e").alias("a")).hint("merge"), "a", "left_semi").join(texts.select(F.col("e").alias("b")).hint("merge"), "b", "left_semi"), F.max_by("a", F.struct("c", (-F.col("a")).alias("a"))), F.min("a")), 2 * n)
    roots = components(swept(join.verified(asked, texts)))
    place = placed(roots)
    left = swept(join.crossing(entries, place.where("e <> root")))
    # while groups are large, a round of chance partners joins more of them
    for seed in range(1, rounds + 1):
        if not join.many(left):
            break
        chance = F.xxhash64("a", "b", F.lit(seed))
        some = join.pairs(left, seed).join(asked.hint("merge"), ["a", "b"], "left_anti")
        some = saved(two(some, F.min_by("a", chance), F.max_by("a", chance)), 2 * n)
        new = swept(join.verified(some, texts))
        asked, roots = saved(asked.unionByName(some), 2 * n * (seed + 1)), joined(roots, new)
        place = placed(roots)
        fruitless = new.count() * 10 < some.count()
        left = swept(join.crossing(entries, place.where("e <> root")))
        if fruitless:
            break
    # and at last all pairs that still cross components
    rest = swept(join.pairs(left).join(asked.hint("merge"), ["a", "b"], "left_anti"))
    place = placed(joined(roots, saved(join.verified(rest, texts)))).select("e", "root")
    rooted = sets.where("n > 0").select("k", "n", "e").join(place.hint("merge"), "e").select("k", "n", "root")
    least = rooted.groupBy("root").agg(F.min("k").alias("component_id"))
    out = rooted.join(least.hint("merge"), "root").select("k", "n", "component_id").unionByName(sets.where("n = 0").select("k", "n", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")
