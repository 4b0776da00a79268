import itertools

import numpy as np
import pytest
from test_repeats import ordered

import re
from pathlib import Path

from glyphsift.llm import common, components, jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df, **how):
    return sorted((tuple(r) for r in jaccard.classes(df, **how).collect()), key=str)


def test_edges(edges):
    assert got(edges, batch_bytes=3000) == brute(ordered(edges))


def test_near_copies_in_many_batches(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for c in range(25):
            w = list(base)
            for i in rng.choice(60, rng.integers(0, 4), replace=False):
                w[i] = f"c{c}x{i}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, batch_bytes=2000) == brute(rows)


def test_empty_table(nothing):
    assert jaccard.classes(nothing).count() == 0


@pytest.mark.parametrize("boundary", [0, 40, 1000])
def test_signatures_meet(boundary):
    """Linked sets share a signature, on either side of the boundary, and their rests allow the link."""
    rng = np.random.default_rng(boundary)
    for _ in range(300):
        n = int(rng.integers(4, 80))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, max(1, n // 5)))], rng.choice(1 << 40, int(rng.integers(0, 3))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        rank = lambda s: (s % np.uint64(3)).astype(np.int64)
        (x, p), (y, q) = (jaccard.signatures(s, rank(s), 80, boundary) for s in (a, b))
        _, i, j = np.intersect1d(x, y, return_indices=True)
        sizes = [np.full(len(i), len(s)) for s in (a, b)]
        assert jaccard.may_link(sizes[0], p[i], sizes[1], q[j], 80).any()


def test_boundary_by_cost():
    assert jaccard.cheapest_boundary([(10, 1000)], 80, 4.0) >= 8
    assert jaccard.cheapest_boundary([(1000, 1000)], 80, 4.0) in (0, *range(8, 129, 4))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    roots = components.components(df)
    named = {r["node"]: r["root"] for r in roots.collect()}
    assert all(named[i] == 1 for i in range(1, 41)) and named[101] == named[102] == 100
    more = components.joined(roots, spark.createDataFrame([(40, 102), (500, 501)], "a long, b long"))
    named = {r["node"]: r["root"] for r in more.collect()}
    assert named[102] == 1 and named[501] == 500


def test_small_tables_go_to_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions; each file may start processes. What tasks remember is bounded too."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = [[f"c{c}x{i}" if i in rng.choice(60, 3, replace=False) else w for i, w in enumerate(base)] for c in range(60)]
    rows = [(c, " ".join(w)) for c, w in enumerate(texts)]
    monkeypatch.setattr(jaccard, "KNOWN", 200)
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert got(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=2000) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [len(list(d.glob("part-*"))) for d in set(folder.iterdir()) - there]
    assert len(files) >= 15 and sum(n >= 24 for n in files) <= 8, sorted(files)
