"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped."""

from __future__ import annotations

import gc
import json
import os
import sys
import types
import uuid
import zlib
from array import array
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, joined_buffers, mixed, text_bytes, word_hashes

#: Chunks of text whose ids a worker remembers, of about 30 bytes each; bounds its memory.
REMEMBERED = 3_000_000
#: Marks that the tokenizer's pattern cuts off the letter before them (fixed values).
MARKS = ".,;:!?"


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values one after another, and their n + 1 offsets."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


class Remembered:
    """Ids of chunks in arrays sorted by a 64-bit hash; a second hash of 32 bits must agree as well.

    A chunk is a word with the space or line feed before it, if any. Its size is -1 if it doesn't say how its
    text is cut: it has other white space, nothing else, or the name of a special token. When there are too
    many, the half that texts had last stays.
    """

    def __init__(self, encode, special: list[str], dtype: np.dtype):
        self.encode, self.special, self.dtype, self.part, self.marks = encode, special, dtype, 0, {}
        self.keys, self.check, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)
        (self.feed,) = encode(["\n"])

    def ids_of(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids begin in ``ids``, and how many they are."""
        self.part += 1
        raw, at = joined_buffers(chunks)
        keys = word_hashes(raw, at[:-1], at[1:])
        # the sum of a chunk's scrambled bytes with their places tells apart what the first hash might not
        marks = mixed(raw.astype(np.uint64) + (np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64) * np.uint64(257))
        check = (np.add.reduceat(marks, at[:-1]) if len(keys) else marks).astype(np.uint32)
        where, known = self._find(keys, check)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(chunks.take(pa.array(new)).to_pylist(), keys[new], check[new])
            where, _ = self._find(keys, check)
        self.seen[where] = self.part
        return self.start[where], self.size[where]

    def _find(self, keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return where, (self.keys[where] == keys) & (self.check[where] == check)

    def _learn(self, chunks: list[bytes], keys: np.ndarray, check: np.ndarray) -> None:
        if len(self.keys) > REMEMBERED:
            self._forget()
        cores, texts, marks, odd = [], [], [], []
        for c in chunks:
            text = c.decode()
            word = text[1:] if text[0] in " \n" else text
            odd.append(word.split() != [word] or any(x in word for x in self.special))
            core = text.rstrip(MARKS)
            texts.append(text if odd[-1] or not core[-1:].isalpha() else core)
            marks.append(text[len(texts[-1]) :])
        cores = list(dict.fromkeys(t for t, no in zip(texts, odd, strict=True) if not no))
        got = self.encode([t[1:] if t[0] == "\n" else t for t in cores])
        found = {t: self.feed + x if t[0] == "\n" else x for t, x in zip(cores, got, strict=True)}
        new = [m for m in dict.fromkeys(marks) if m not in self.marks]
        if len(self.marks) > 10_000:
            self.marks, new = {}, list(dict.fromkeys(marks))
        self.marks.update(zip(new, self.encode(new), strict=True))
        each = [b"" if no else found[t] + self.marks[m] for t, m, no in zip(texts, marks, odd, strict=True)]
        size = np.fromiter(map(len, each), np.int32, len(each)) // self.dtype.itemsize
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(each), self.dtype)])
        size[odd] = -1
        by = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[by])
        for name, values in (("keys", keys), ("check", check), ("start", start), ("size", size), ("seen", np.full(len(keys), self.part, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), to, values[by]))

    def _forget(self) -> None:
        keep = self.seen >= max(np.median(self.seen), self.part - 1)
        for name in ("keys", "check", "start", "size", "seen"):
            setattr(self, name, getattr(self, name)[keep])
        self.ids, ends = gathered(self.ids, self.start, np.maximum(self.size, 0))
        self.start = ends[:-1]


class ChunkEncoder:
    """Encodes texts with a byte-level BPE tokenizer as the library does, special tokens included.

    Where every white space is one space or one line feed between two characters that aren't white space,
    the tokenizer's own splitting pattern always cuts before that space and around that line feed, and no
    merge crosses a cut. So the ids of such a text are the ids of its chunks, one after another. A column's
    chunks are numbered by Arrow, the library encodes each different one that the worker doesn't remember, and
    numpy puts the ids together. Any other text is encoded whole, and so is one with a special token's name.
    """

    def __init__(self, path: str, dtype: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.end_id = Tokenizer.from_file(path), np.dtype(dtype), end_id
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memory = Remembered(self._plain, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], self.dtype)

    def _plain(self, texts: list[str]) -> list[bytes]:
        encode, code = self.tokenizer.encode, self.code
        return [array(code, encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and how many each text has."""
        raw, at = joined_buffers(column)
        begins = raw == 32
        begins |= raw == 10
        begins[at[:-1][at[:-1] < at[1:]]] = True
        begins = np.flatnonzero(begins)
        offsets = np.append(begins, len(raw))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        # millions of strings come and go here and none in a cycle, so the cyclic collector rests meanwhile
        resting = gc.isenabled()
        gc.disable()
        try:
            start, size = self.memory.ids_of(chunks.dictionary)
        finally:
            if resting:
                gc.enable()
        odd = np.append(size < 0, False)
        end = np.array([] if self.end_id is None else [self.end_id], self.dtype)
        ids, ends = gathered(self.memory.ids, start, np.maximum(size, 0))
        offsets = np.append(ends, ends[-1] + len(end)) * self.dtype.itemsize
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(odd), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([ids, end]))])
        # one more chunk behind each text: its end id
        first = np.searchsorted(begins, at)
        codes = np.insert(chunks.indices.to_numpy(zero_copy_only=False), first[1:], len(each) - 1)
        rows = first + np.arange(len(first))
        _, ends, data = each.take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, np.int64, len(codes) + 1) // self.dtype.itemsize
        out = np.frombuffer(data, self.dtype) if data is not None else np.zeros(0, self.dtype)
        counts = np.diff(ends[rows])
        whole = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(odd[codes])])[rows])) if odd.any() else []
        if len(whole):
            parts, done = [], 0
            texts = [raw[at[i] : at[i + 1]].tobytes().decode() for i in whole]
            for i, got in zip(whole.tolist(), self._plain(texts), strict=True):
                parts += [out[done : ends[rows[i]]], np.frombuffer(got, self.dtype), end]
                counts[i], done = len(parts[-2]) + len(end), ends[rows[i + 1]]
            out = np.concatenate([*parts, out[done:]])
        return out, counts


def encoder_of(path: str, dtype: str, end_id: int | None) -> ChunkEncoder:
    """This worker's encoder: what one task has learned serves the next."""
    state = sys.modules.setdefault("_glyphsift_worker", types.ModuleType("_glyphsift_worker"))
    kept = state.__dict__.setdefault("encoders", {})
    key = (path, dtype, end_id)
    if key not in kept:
        kept.clear()
        kept[key] = ChunkEncoder(path, dtype, end_id)
    return kept[key]


def _parts(sizes: list[int], most: int = 8_000_000):
    """Runs of rows of about ``most`` bytes."""
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _open(folder: str):
    fs, path = pafs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{os.path.abspath(folder)}")
    return fs, path


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, part_bytes: int = 16 << 20) -> dict:
    """Writes the ids of all texts in ascending key order; returns the manifest, also written as manifest.json.

    A part has three files: .bin the ids (unsigned little-endian, 2 bytes if the vocabulary fits, else 4),
    .off the 64-bit offsets of its documents and their end, .key the number of null keys and then the keys.
    A part's base is the prefix sum of the token counts before it. Tasks write under names of their own, and
    the manifest names those that ended, so a repeated task changes nothing. A part is of about ``part_bytes``
    of text. Null keys come first; a null text is empty, and an empty one has its end id only. Rows with equal
    keys go by their text, repeated rows follow each other. Very long texts are encoded alone. An empty table
    gives no parts. Other columns are not read, whatever their names.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(size, end_id or 0) < 1 << 16 else "<u4"
    spark = docs.sparkSession
    n = max(1, -(-text_bytes(docs, text) // part_bytes))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def put(batches):
        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, at = _open(folder)
        encoder, offsets, keys, nulls, total = None, [np.zeros(1, np.int64)], [], 0, 0
        with out.open_output_stream(f"{at}/{name}.bin") as ids:
            for batch in batches:
                nulls += batch.column(0).null_count
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                encoder = encoder or encoder_of(vocabulary, dtype, end_id)
                sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for a, b in _parts(sizes.tolist()):
                    got, counts = encoder.encode(batch.column(1).slice(a, b - a))
                    ids.write(got.data)
                    offsets.append(total + np.cumsum(counts))
                    total = int(offsets[-1][-1])
        if total or keys:
            with out.open_output_stream(f"{at}/{name}.off") as f:
                f.write(np.concatenate(offsets).astype("<i8").tobytes())
            with out.open_output_stream(f"{at}/{name}.key") as f:
                f.write(np.concatenate([[nulls], *keys]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [sum(map(len, keys))], "tokens": [total]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    # rows of one key are dealt by the beginnings of their texts, which is in line with the order of texts
    done = rows.repartitionByRange(n, "k", F.substring("t", 1, 32)).sortWithinPartitions("k", "t").mapInArrow(put, "part int, name string, docs long, tokens long").collect()
    parts, base = [], 0
    for r in sorted(done, key=lambda r: r["part"]):
        if r["docs"]:
            parts.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
            base += r["tokens"]
    manifest = {"dtype": dtype, "tokens": base, "parts": parts}
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """One file as an array: memory-mapped where the folder is a file system, else read."""
    fs, path = _open(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}.{kind}", dtype, "r") if os.path.getsize(f"{path}/{name}.{kind}") else np.zeros(0, dtype)
    with fs.open_input_file(f"{path}/{name}.{kind}") as f:
        return np.frombuffer(f.read(), dtype)


def documents(folder: str, manifest: dict):
    """(key, ids) of each document of the files, in order."""
    for part in manifest["parts"]:
        offsets, keys = mapped(folder, part["name"], "off", "<i8"), mapped(folder, part["name"], "key", "<i8")
        ids = mapped(folder, part["name"], "bin", manifest["dtype"])
        for i in range(part["docs"]):
            yield (None if i < keys[0] else int(keys[i + 1])), ids[offsets[i] : offsets[i + 1]]


def read(spark: SparkSession, folder: str, manifest: dict, key: str = "doc_id") -> DataFrame:
    """One row for each document of the files: key, start, n_tokens, ids_crc32 (of 32-bit ids).

    Null keys come back as null, repeated rows each as a row; a manifest without parts gives no rows.
    """
    parts, dtype = manifest["parts"], manifest["dtype"]

    def got(frames):
        for frame in frames:
            for p in frame["id"]:
                part = parts[p]
                offsets, keys = mapped(folder, part["name"], "off", "<i8"), mapped(folder, part["name"], "key", "<i8")
                ids = mapped(folder, part["name"], "bin", dtype)
                for a in range(0, part["docs"], 20_000):
                    b = min(a + 20_000, part["docs"])
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    who = pd.Series(keys[a + 1 : b + 1].astype("int64"), dtype="Int64").mask(np.arange(a, b) < keys[0])
                    yield pd.DataFrame({key: who, "start": part["base"] + offsets[a:b].astype("int64"), "n_tokens": np.diff(offsets[a : b + 1]).astype("int64"), "ids_crc32": crc})

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInPandas(got, f"{key} long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, folder: str | None = None, **how) -> DataFrame:
    """Writes the files (to a fresh folder of the shared one by default) and reads them back; see ``write`` for edge cases."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    return read(spark, folder, write(docs, folder, vocabulary, **how))
