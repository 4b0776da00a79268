"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, fresh_dir, joined_buffers, mixed, released, removed, saved, word_hashes, word_spans

#: Words of a passage, and from one passage's start to the next's.
PASSAGE, STRIDE = 64, 32
#: A vocabulary's rows that are summed together.
SLICE = 1024
#: Items with fewer words are looked for as they are.
LEAST_WORDS = 4


def slices(batches, rows: int = 192):
    """Arrow batches in parts whose arrays stay in the processor's caches."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)
    released()


def words_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z lower-cased) of all rows, and each row's first of n + 1.

    Every character from U+3000 on is a word of its own, as scripts without spaces stand there.
    """
    raw, at = joined_buffers(column)
    raw = LOWER[raw]
    start, end, first = word_spans(raw, at, LETTERS)
    alone = np.flatnonzero((raw >= 0xE3) & (raw != 0xEE) & (raw != 0xEF))
    if len(alone):
        behind = alone + np.where(raw[alone] >= 0xF0, 4, 3)
        inside = behind < end[np.searchsorted(start, alone, side="right") - 1]
        start = np.unique(np.concatenate([start, alone, behind[inside]]))
        end = np.minimum(end[np.searchsorted(end, start, side="right")], np.append(start[1:], len(raw)))
        first = np.searchsorted(start, at)
    return word_hashes(raw, start, end), first


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(3) + hashes[j : j + len(out)])
    return out


class Items:
    """One block of a benchmark: ids, words, the place where the answer begins, and the sorted vocabulary.

    short: by number of words, the hash of each shorter item to its ids.
    """

    def __init__(self, rows: list[tuple]):
        rows = [(i, t) for i, t in rows if t]
        hashes, first = words_in(pa.array([t for _, t in rows], pa.large_string()))
        keep = [j for j in range(len(rows)) if first[j + 1] - first[j] >= LEAST_WORDS]
        self.short: dict = {}
        for j, (i, _) in enumerate(rows):
            if 0 < (n := int(first[j + 1] - first[j])) < LEAST_WORDS:
                self.short.setdefault(n, {}).setdefault(int(sequences(hashes[first[j] : first[j + 1]], n)[0]), []).append(i)
        self.ids = [rows[j][0] for j in keep]
        self.words = [hashes[first[j] : first[j + 1]].tolist() for j in keep]
        self.answer = [self._answer(rows[j][1], len(w)) for j, w in zip(keep, self.words, strict=True)]
        self.vocabulary = np.unique(np.concatenate([np.array(w, np.uint64) for w in self.words])) if keep else np.zeros(0, np.uint64)
        self.masks = []
        for w in self.words:
            mask: dict = {}
            for i, h in enumerate(w):
                mask[h] = mask.get(h, 0) | 1 << i
            self.masks.append(mask)

    @staticmethod
    def _answer(text: str, n: int) -> int:
        """The answer is what follows the last question mark, else the last sentence."""
        body = text.rstrip(" .!?\n\t")
        cut = max(body.rfind("?"), -1)
        if cut < 0:
            cut = max(body.rfind(c) for c in (". ", "! ", ".\n", "!\n", "\n"))
        tail = words_in(pa.array([body[cut + 1 :]], pa.large_string()))[0] if cut >= 0 else []
        return n - len(tail) if 0 < len(tail) < n else 0

    def pieces(self) -> list[tuple[int, list]]:
        """(item, words) of all items, those longer than a passage cut into overlapping parts as long as one."""
        return [(i, w[a : a + PASSAGE]) for i, w in enumerate(self.words) for a in (*range(0, len(w) - PASSAGE, STRIDE), max(0, len(w) - PASSAGE))]

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        pieces = self.pieces()
        out = np.zeros((len(pieces), len(self.vocabulary)), np.float32)
        for i, (_, w) in enumerate(pieces):
            out[i, np.searchsorted(self.vocabulary, np.array(w, np.uint64))] = 1
        return out * idf


def terms_of(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray):
    """(passage, term) pairs without repeats, sorted; each passage's row and its number there."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
    base = np.cumsum(count) - count
    row_of = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(row_of)) - base[row_of]
    if not len(vocabulary) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), row_of, number
    # most words are in no item: a table over 16 bits of the hash tells quickly
    maybe = np.zeros(1 << 16, bool)
    maybe[vocabulary & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(maybe[hashes & np.uint64(0xFFFF)])
    term = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    hit = vocabulary[term] == hashes[at]
    at, term = at[hit], term[hit]
    row = np.searchsorted(first, at, side="right") - 1
    last = (at - first[row]) // STRIDE  # a word is in the passage that begins last before it, and in the one before
    pairs = []
    for j in (last, last - 1):
        ok = (j >= 0) & (j < count[row])
        pairs.append((base[row[ok]] + j[ok]) * len(vocabulary) + term[ok])
    key = np.sort(np.concatenate(pairs))
    key = key[np.diff(key, prepend=-1) > 0]
    return key // len(vocabulary), key % len(vocabulary), row_of, number


def summed(term: np.ndarray, heads: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each group of terms (from its head to the next), the sum of the table's rows."""
    size = np.diff(np.append(heads, len(term)))
    order = np.argsort(-size, kind="stable")
    size, heads = size[order], heads[order]
    out = np.zeros((len(heads), table.shape[1]), table.dtype)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # groups that have a term j
        out[:n] += table[term[heads[:n] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def spread(term: np.ndarray, heads: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Adds row j of the table to the rows of ``out`` that group j's terms name; the transpose of ``summed``."""
    order = np.argsort(term, kind="stable")
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(term))))[order]
    first = np.flatnonzero(np.diff(term[order].astype(np.int64), prepend=-1))
    names, size = term[order[first]], np.diff(np.append(first, len(term)))
    often = size > 128  # rows summed one by one would take as many steps
    which = np.repeat(often, size)
    dense = np.zeros((int(often.sum()), len(heads)), table.dtype)
    dense[np.repeat(np.arange(len(dense)), size[often]), group[which]] = 1
    out[names[often]] += dense @ table
    out[names[~often]] += summed(group[~which], np.cumsum(size[~often]) - size[~often], table)


def common_subsequence(mask: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of an item (by its words' bit masks) and some words."""
    row = full = (1 << n) - 1
    for w in words:
        m = mask.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Screen:
    """Everything that a worker needs to find one block's items in texts."""

    def __init__(self, items: Items, idf: np.ndarray, latent: np.ndarray, cosine: float, ratio: float, loose: float):
        self.items, self.cosine, self.ratio, self.loose = items, cosine, ratio, loose
        self.weighted = latent * idf.astype(np.float32)[:, None]
        seen = items.matrix(idf) @ latent
        self.holds = (items.matrix(np.ones(len(idf))) > 0).T.astype(np.uint8)
        self.owner = np.array([i for i, _ in items.pieces()], np.int64)
        n, distinct = np.array([len(w) for _, w in items.pieces()]), self.holds.sum(0)
        # a found item lacks so few of its different words; the passage that covers most of a longer one has 0.4 of them
        all_kept = distinct - (1 - min(ratio, loose)) * n - 1e-6
        least = np.where(n + n // 4 + 2 <= PASSAGE - STRIDE + 1, all_kept, np.minimum(0.4 * distinct, all_kept))
        self.least_shared = np.maximum(0, np.ceil(least)).astype(np.uint8)
        # the other words of a passage push a short item's cosine down, by the root of its share and more if they are rare
        self.least_cosine = (cosine * np.minimum(1, n / PASSAGE)).astype(np.float32)
        self.known = seen / np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)

    def candidates(self, hashes, first):
        """(row, passage number, item, cosine) of all passages near an item in the latent space that could hold it."""
        passage, term, row_of, number = terms_of(hashes, first, self.items.vocabulary)
        if not len(passage):
            return []
        heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        best: dict = {}  # of an item's pieces the nearest
        for a in range(0, len(heads), 4096):
            z = heads[a + 4096] if a + 4096 < len(heads) else len(passage)
            t, at = term[heads[a] : z], heads[a : a + 4096] - heads[a]
            # few passages share enough words with any piece; only those are brought into the latent space
            i, piece = np.nonzero(summed(t, at, self.holds) >= self.least_shared)
            if not len(i):
                continue
            size, hopeful = np.diff(np.append(at, len(t))), np.zeros(len(at), bool)
            hopeful[i] = True
            v = summed(t[np.repeat(hopeful, size)], np.cumsum(size[hopeful]) - size[hopeful], self.weighted)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            row = np.cumsum(hopeful)[i] - 1
            near = np.concatenate([(v[row[j : j + 4096]] * self.known[piece[j : j + 4096]]).sum(axis=1) for j in range(0, len(row), 4096)])
            ok = near >= self.least_cosine[piece]
            p = passage[heads[a + i[ok]]]
            for r, k, item, c in zip(row_of[p].tolist(), number[p].tolist(), self.owner[piece[ok]].tolist(), near[ok].tolist(), strict=True):
                best[r, k, item] = max(c, best.get((r, k, item), c))
        return [(*at, c) for at, c in best.items()]

    def matches(self, column: pa.Array) -> list[tuple]:
        """(row, item id, word, cosine, ratio, answer) of each row's best match with each item it contains."""
        hashes, first = words_in(column)
        best: dict = {}
        short: dict = {}
        for n, ids in self.items.short.items():
            found = sequences(hashes, n)
            for at in np.flatnonzero(np.isin(found, np.array(list(ids), np.uint64))).tolist():
                row = int(np.searchsorted(first, at, side="right")) - 1
                if at + n <= first[row + 1]:
                    for i in ids[int(found[at])]:
                        short.setdefault((row, i), at - int(first[row]))
        for row, number, item, cosine in self.candidates(hashes, first):
            got = self._aligned(hashes, int(first[row]), int(first[row + 1]), number, item, cosine)
            if got and got > best.get((row, item), (0.0,)):
                best[row, item] = got
        out = [(row, self.items.ids[item], word, cosine, ratio, answer) for (row, item), (ratio, answer, cosine, word) in best.items()]
        return sorted(out + [(row, i, word, 1.0, 1.0, True) for (row, i), word in short.items()])

    def _aligned(self, hashes, begin: int, end: int, number: int, item: int, cosine: float):
        words, mask = self.items.words[item], self.items.masks[item]
        n = len(words)
        a = max(begin, begin + number * STRIDE - n)
        z = min(end, begin + number * STRIDE + PASSAGE + n)
        region = hashes[a:z].tolist()
        least = min(self.ratio, self.loose) * n
        if common_subsequence(mask, n, region) < least:
            return None
        # the words must stand close together: a stretch hardly longer than the item
        width, step, best = n + n // 4 + 2, max(1, n // 8), None
        tail = words[self.items.answer[item] :]
        ends: dict = {}
        for i, w in enumerate(tail):
            ends[w] = ends.get(w, 0) | 1 << i
        for s in range(0, max(1, len(region) - width + step), step):
            part = region[s : s + width]
            length = common_subsequence(mask, n, part)
            if length >= least and (best is None or length >= best[0]):
                found = common_subsequence(ends, len(tail), part) >= 0.9 * len(tail)
                if (length >= self.ratio * n or (length >= self.loose * n and found)) and (best is None or (length, found) > best[:2]):
                    best = (length, found, s)
        if best is None:
            return None
        length, found, s = best
        return (length / n, found, cosine, a - begin + s)


def term_type(v: int):
    """The type in which a vocabulary's terms are stored."""
    return np.uint16 if v <= 1 << 16 else np.uint32


def stored(batches, v: int):
    """(number of passages, sizes, terms) of each stored slice; see ``Decontaminator._passages``."""
    for batch in batches:
        for n, size, term in zip(*batch.columns, strict=True):
            yield n.as_py(), np.frombuffer(size.as_buffer(), np.uint8), np.frombuffer(term.as_buffer(), term_type(v))


#: Parts of sums of arrays: which slice of the array, from which task, and its values.
SUMS = "slice int, part int, sum binary"
#: So many parts of a slice are added at a time.
FAN = 16


def numbered(number: int, values: np.ndarray) -> pa.RecordBatch:
    """A slice of this task's sum; see SUMS."""
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["slice", "part", "sum"])


def totals(rows: DataFrame, parts: int, kind=np.float64) -> list[np.ndarray]:
    """The float64 sums of all slices, in order, of at most ``parts`` tasks' values of this kind.

    They are added in rounds, FAN parts of one slice at a time and in the parts' order, so that reruns agree.
    """
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("sum", pa.binary())])

    def adding(kind):
        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("part")
            out = sum(np.frombuffer(b.as_buffer(), kind).astype(np.float64) for b in group.column("sum"))
            return pa.table([group.column("slice")[:1], pa.array([group.column("part")[0].as_py() // FAN], pa.int32()), pa.array([out.tobytes()], pa.binary())], schema=schema)

        return add

    while True:
        rows, parts, kind = rows.groupBy("slice", F.floor(F.col("part") / FAN)).applyInArrow(adding(kind), SUMS), -(-parts // FAN), np.float64
        if parts == 1:
            return [np.frombuffer(r["sum"]) for r in sorted(rows.collect(), key=lambda r: r["slice"])]


class Decontaminator:
    """Latent spaces of a benchmark over a corpus, one for each block of items; see ``matches``.

    A block has about ``block_items`` pieces of 64 words at most, so at most 32,000 different words at 500: its
    arrays (a latent row of 4 ``rank`` bytes and 2 bytes for each piece, for each word) take 64 MB at most. One
    block is fitted, on all passages of the corpus, and its texts searched, after another.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rank: int = 256, block_items: int = 500, cosine: float = 0.4, ratio: float = 0.8, loose: float = 0.65, seed: int = 11):
        self.docs, self.text, self.rank, self.seed, self.bounds = docs, text, rank, seed, (cosine, ratio, loose)
        self.items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).distinct()

        def pieces(batches):
            for part in slices(batches):
                n = np.diff(words_in(part.column(0))[1])
                yield pa.RecordBatch.from_arrays([pa.array([int(np.clip(-(-(n - PASSAGE) // STRIDE) + 1, 1, block_items).sum())])], ["n"])

        self.blocks = max(1, -(-int(self.items.select("t").mapInArrow(pieces, "n long").agg(F.sum("n")).first()[0] or 0) // block_items))

    def screens(self):
        """The screen of one block after another."""
        for j in range(self.blocks):
            block = self.items.where(F.pmod(F.xxhash64("i"), F.lit(self.blocks)) == j)
            items = Items([(r["i"], r["t"]) for r in block.orderBy("i", "t").collect()])
            if items.ids:
                folder = fresh_dir(self.docs.sparkSession, "passages")
                passages = self._passages(self.docs, items.vocabulary, folder)
                idf, n_terms = self._weights(passages, items.vocabulary)
                latent = self._latent(passages, items, idf, n_terms)
                removed(self.docs.sparkSession, folder)
                yield Screen(items, idf, latent, *self.bounds)
            elif items.short:
                yield Screen(items, np.zeros(0), np.zeros((0, self.rank), np.float32), *self.bounds)

    def _passages(self, docs: DataFrame, vocabulary: np.ndarray, folder: str) -> DataFrame:
        """(n, size, term): for each slice of rows its number of passages, and of those with a known word the number
        of terms and the terms. Written to ``folder``, as weights, sketch and rotation each read them once."""
        known, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), term_type(len(vocabulary))

        def f(batches):
            for part in slices(batches):
                passage, term, row_of, _ = terms_of(*words_in(part.column(0)), known.value)
                size = np.diff(np.flatnonzero(np.diff(passage, prepend=-1, append=-1))).astype(np.uint8)  # 64 at most
                yield pa.RecordBatch.from_arrays([pa.array([len(row_of)]), pa.array([size.tobytes()], pa.binary()), pa.array([term.astype(kind).tobytes()], pa.binary())], ["n", "size", "term"])

        docs.select(F.col(self.text).alias("t")).mapInArrow(f, "n long, size binary, term binary").write.parquet(folder)
        return docs.sparkSession.read.parquet(folder)

    def _weights(self, passages: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
        """Inverse passage frequencies of the vocabulary over all passages, and how many terms these have."""
        v = len(vocabulary)

        def f(batches):
            count, total = np.zeros(v, np.int64), 0
            for n, _, term in stored(batches, v):
                count += np.bincount(term, minlength=v)
                total += n
            term = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(count[term], total))], ["term", "n"])

        rows = passages.mapInArrow(f, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
        total = int(n[term < 0].sum())
        count = np.zeros(v)
        count[term[term >= 0]] = n[term >= 0]
        return np.log((1 + total) / (1 + count)) + 1e-6, int(count.sum())

    def _latent(self, passages: DataFrame, items: Items, idf: np.ndarray, n_terms: int) -> np.ndarray:
        """The right singular vectors of the normalised TF-IDF passages, by a distributed randomised SVD.

        Fitted on the items and on every passage of the corpus. A task adds up about 16 million terms, or more
        tasks than 16 would each ship a sum as large as the vocabulary for little work.
        """
        v = len(items.vocabulary)
        width, seed, weight = min(self.rank + 16, v), self.seed, idf.astype(np.float32)
        parts = max(16, n_terms >> 24)
        passages = passages.coalesce(parts)
        context = passages.sparkSession.sparkContext

        def products(batches, matrix):
            """(heads, terms, product, squared norms) of a few thousand passages at a time: their terms' rows summed."""
            scaled = matrix * weight[:, None]
            for _, size, term in stored(batches, v):
                at = np.append(0, np.cumsum(size, dtype=np.int64))
                for a in range(0, len(size), 4096):
                    z = min(a + 4096, len(size))
                    t, heads = term[at[a] : at[z]], at[a:z] - at[a]
                    yield heads, t, summed(t, heads, scaled), np.add.reduceat(weight[t] ** 2, heads)

        def normal():
            return np.random.default_rng(seed).standard_normal((v, width)).astype(np.float32)

        def sketch(batches):
            out = np.zeros((v, width), np.float32)
            for heads, t, product, square in products(batches, normal()):
                spread(t, heads, product / square[:, None], out)
            out *= weight[:, None]
            for a in range(0, v, SLICE):
                yield numbered(a // SLICE, out[a : a + SLICE])

        y = np.concatenate([b.reshape(-1, width) for b in totals(passages.mapInArrow(sketch, SUMS), parts, np.float32)])
        own = items.matrix(idf)
        own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        y += own.T @ (own @ normal())
        basis = context.broadcast(np.linalg.qr(y)[0].astype(np.float32))

        def gram(batches):
            out = np.zeros((width, width))
            for _, _, product, square in products(batches, basis.value):
                product /= np.sqrt(square)[:, None]
                out += product.T @ product
            yield numbered(0, out)

        q = basis.value
        g = (own @ q).T @ (own @ q) + totals(passages.mapInArrow(gram, SUMS), parts)[0].reshape(width, width)
        return (q @ np.linalg.eigh(g)[1][:, ::-1][:, : self.rank]).astype(np.float32)

    def matches(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """One row for each pair of a document and an item found in it: key, item_id, word, cosine, lcs_ratio, answer_found.

        ``word`` is where the stretch begins. Every passage is compared with every item, those longer than a
        passage piece by piece; those at ``cosine`` or more in the latent space (for an item of n < 64 words, n / 64
        of that) are aligned. An item is found where ``ratio`` of its words stand in order within a stretch hardly
        longer than it, or ``loose`` of them and its whole answer there. Null and empty texts match nothing.
        Items under 4 words are found where their words stand one after another; items without words aren't
        looked for. Of equally good stretches the first counts. Repeated rows match alike; an empty table or benchmark gives no
        rows. Other columns are not read.
        """
        rows = docs.select(F.col(key).cast("long").alias("k"), F.col(self.text).alias("t"))
        schema = f"{key} long, item_id long, word long, cosine double, lcs_ratio double, answer_found boolean"
        out = None
        for screen in self.screens():

            def f(batches, one=screen):
                for part in slices(batches):
                    if got := one.matches(part.column(1)):
                        keys = part.column(0).to_pylist()
                        cols = [[keys[m[0]] for m in got], [m[1] for m in got], [m[2] for m in got], [round(m[3], 4) for m in got], [round(m[4], 4) for m in got], [bool(m[5]) for m in got]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], [key, "item_id", "word", "cosine", "lcs_ratio", "answer_found"])

            found = rows.mapInArrow(f, schema)
            found = found if self.blocks == 1 else saved(found)
            out = found if out is None else out.unionByName(found)
        return docs.sparkSession.createDataFrame([], schema) if out is None else out

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, with all their columns, in which no item is found; see ``matches`` for edge cases."""
        for screen in self.screens():
            place = docs.columns.index(self.text)

            def f(batches, screen=screen, place=place):
                for part in slices(batches):
                    keep = np.ones(len(part), bool)
                    keep[[m[0] for m in screen.matches(part.column(place))]] = False
                    yield part.filter(pa.array(keep))

            docs = docs.mapInArrow(f, docs.schema)
            docs = docs if self.blocks == 1 else saved(docs)
        return docs
