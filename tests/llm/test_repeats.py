"""Byte and word repeats against brute force."""

import random

import numpy as np
import pytest

from glyphsift.llm import repeats, substrings, suffixes
from glyphsift.llm.common import GAP_PATTERN, sliding_min

import re


def ordered(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def brute_bytes(rows, k):
    seen, out = set(), []
    for key, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - k + 1):
            if data[i : i + k] in seen:
                gone[i : i + k] = b"\1" * k
            else:
                seen.add(data[i : i + k])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def brute_words(rows, k):
    first, words = {}, [[w for w in re.split(GAP_PATTERN, t) if w] for _, t in rows]
    low = lambda key: -(1 << 63) if key is None else key
    for (key, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), low(key))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < low(key):
                gone[i : i + k] = [True] * k
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def plain(x):
    return str(x)


@pytest.mark.parametrize("how", [{}, {"frequent": 1, "batch_bytes": 2000, "bucket_bytes": 1000}])
def test_bytes(edges, how):
    got = [(r["doc_id"], r["n_units"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.dedup(edges, **how).collect()]
    assert sorted(got, key=plain) == sorted(brute_bytes(ordered(edges), 100), key=plain)


@pytest.mark.parametrize("how", [{}, {"frequent": 1, "batch_bytes": 2000, "bucket_bytes": 1000}])
def test_words(edges, how):
    got = [(r["doc_id"], r["n_units"], r["n_removed"], r["kept"]) for r in substrings.dedup(edges, **how).collect()]
    assert sorted(got, key=plain) == sorted(brute_words(ordered(edges), 13), key=plain)


PASSAGE = " ".join(f"hot{i}" for i in range(30))


def hot_rows(n, keys):
    """Texts with one passage in the middle of words of their own."""
    rng = random.Random(5)
    own = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    return [(keys(i), f"{own(35)} {PASSAGE} {own(35)}") for i in range(n)]


def test_null_keys_meet_in_several_batches(spark):
    """Rows without a key: for words they are one key; for bytes one of them is first, whichever it is."""
    rows = hot_rows(300, lambda i: None) + hot_rows(40, lambda i: i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_units"], r["n_removed"], r["kept"]) for r in substrings.dedup(df, frequent=4, batch_bytes=3000).collect()]
    assert sorted(got, key=plain) == sorted(brute_words(ordered(df), 13), key=plain)
    removed = [r["n_removed"] for r in suffixes.dedup(df, frequent=4, batch_bytes=3000).collect()]
    # the first is whole, the others lose the passage and the bytes beside it that an earlier row has too; 40 are copies
    whole = [n for n in removed if n > 2 * len(PASSAGE)]
    assert len(whole) == 40 and sorted(removed)[:2] == [0, len(PASSAGE) + 3]


def test_a_hot_passage_is_not_multiplied(spark):
    df = spark.createDataFrame(hot_rows(6000, int), "doc_id long, text string")
    size = df.selectExpr("sum(octet_length(text))").first()[0]
    for scheme in (suffixes.Bytes(), substrings.Words()):
        steps = repeats.Repeats(scheme)
        batches = steps.batches(df, "doc_id", "text")
        packs = steps.pack(batches, steps.answer(steps.announce(batches))).selectExpr("sum(coalesce(length(strings), 0) + coalesce(length(singles), 0) + coalesce(length(later), 0)) AS sent", "max(length(singles)) AS most").first()
        assert packs["sent"] < 2 * size and packs["most"] < size / 20


def test_buckets_have_several_shards(spark, monkeypatch):
    """With the query's own settings windows are looked up in earlier shards."""
    texts = [r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(1500).collect()]
    asked = []
    found_in = suffixes.Shard.found_in
    monkeypatch.setattr(suffixes.Shard, "found_in", lambda self, other: asked.append(found_in(self, other)) or asked[-1])
    strings = [t for t in texts if len(t) >= 100]
    suffixes.Bytes().later(strings, np.arange(len(strings)))
    assert len(asked) > 1 and any(x.any() for x in asked)


def test_both_on_documents(documents):
    got = [(r["doc_id"], r["n_units"], r["n_removed"], r["kept"]) for r in substrings.dedup(documents).collect()]
    assert sorted(got, key=plain) == sorted(brute_words(ordered(documents), 13), key=plain)
    got = [(r["doc_id"], r["n_units"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.dedup(documents).collect()]
    assert sorted(got, key=plain) == sorted(brute_bytes(ordered(documents), 100), key=plain)


def test_empty_table(nothing):
    assert suffixes.dedup(nothing).count() == substrings.dedup(nothing).count() == 0


@pytest.mark.parametrize(("n", "letters"), [(0, 1), (1, 2), (60, 1), (400, 2), (3000, 4), (2000, 256)])
def test_suffix_array_and_prefixes(n, letters):
    raw = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    data, words = raw.tobytes(), suffixes.eights(raw)
    order, tied, known = suffixes.suffix_array(raw, words, 40)
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(n))
    shared = suffixes.common_prefixes(words, order, tied, known, 40)
    for a, b, h in zip(order[:-1], order[1:], shared[1:], strict=True) if n else ():
        true = next((i for i in range(40) if data[a + i : a + i + 1] != data[b + i : b + i + 1] or not data[a + i : a + i + 1]), 40)
        assert h == true or (h == 0 and true < known)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_shards_merge(shard_bytes):
    rng = random.Random(3)
    pool = [bytes(rng.choice(b"ab cd") for _ in range(150)) for _ in range(5)]
    strings = []
    for _ in range(80):
        a = rng.randint(0, 40)
        strings.append(rng.choice(pool)[a : rng.randint(a + 41, 150)])
    got = {(int(s), int(o) + j) for s, o, n in zip(*suffixes.Bytes(40, shard_bytes).later(strings, np.arange(80)), strict=True) for j in range(n)}
    seen, true = set(), set()
    for i, s in enumerate(strings):
        for j in range(len(s) - 39):
            if s[j : j + 40] in seen:
                true.add((i, j))
            seen.add(s[j : j + 40])
    assert got == true


@pytest.mark.parametrize("width", [1, 2, 7, 64, 69])
def test_sliding_min(width):
    x = np.random.default_rng(1).integers(0, 99, 300)
    assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(300 - width + 1)]
