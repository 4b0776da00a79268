"""Edited items among words that other items know too."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from glyphsift.llm import common, contamination

DATA = "/root/testdata/sf0.01"
COMMON = [f"common{i}" for i in range(400)]


def screen(*texts):
    """A screen of these items whose latent space is the plain one; the words of COMMON are known by further items."""
    more = [" ".join(COMMON[a : a + 40]) for a in range(0, len(COMMON), 40)]
    items = contamination.Items([(i, t) for i, t in enumerate([*texts, *more])])
    v = len(items.vocabulary)
    return contamination.Screen(items, np.ones(v), np.eye(v, dtype=np.float32), 0.4, 0.8, 0.65)


def among(words, at=150, seed=1):
    """The words inside a text of common words in random order, where no other item stands."""
    host = np.random.default_rng(seed).permutation(COMMON).tolist()
    return " ".join(host[:at] + words + host[at:])


def found(tool, text):
    return {(m[1], m[5]) for m in tool.matches(pa.array([text]))}


def test_whole_answer_decides():
    question, answer = [f"asked{i}" for i in range(18)], [f"answer{i}" for i in range(6)]
    tool = screen(" ".join(question) + "? " + " ".join(answer))
    kept = [w for i, w in enumerate(question) if i % 5 not in (1, 3)]  # 11 of 18: 17 of all 24 words
    assert found(tool, among(kept + answer)) == {(0, True)}
    # as many words in order, but not the whole answer
    assert found(tool, among(question[:14] + answer[:3])) == set()
    # the answer and too few other words
    assert found(tool, among(question[:9] + answer)) == set()


def test_long_items():
    for n in (59, 65, 100, 200, 500):
        item = [f"long{i}" for i in range(n)]
        tool = screen(" ".join(item))
        fewer = [w for i, w in enumerate(item) if i % 6]
        other = [f"new{i}" if i % 6 == 0 else w for i, w in enumerate(item)]
        more = [x for i, w in enumerate(item) for x in ([w, f"new{i}"] if i % 6 == 0 else [w])]
        for words in (item, fewer, other, more):
            for at in (0, 150, 171, 400):
                assert {k for k, _ in found(tool, among(words, at))} == {0}, (n, len(words), at)
        assert found(tool, among(item[: n // 2])) == set()


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "長江流經多少個省份？答案是十一個省級行政區。"
    items = [(1, "Blue whale"), (2, "two, two!"), (3, "one"), (4, chinese), (5, ""), (6, None), (7, "...")]
    texts = ["the blue, WHALE swims", "a blue and whale", "two two two", "One more", "none", "前文" + chinese[:7] + "的" + chinese[7:] + "後文", "長江流經", "whale blue", "", None, "blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tool = contamination.Decontaminator(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in tool.matches(docs).collect()} == {(0, 1), (2, 2), (3, 3), (5, 4)}
    assert [r["doc_id"] for r in tool.clean(docs).orderBy("doc_id").collect()] == [1, 4, 6, 7, 8, 9, 10]
    only = contamination.Decontaminator(docs, spark.createDataFrame(items[:1], "item_id long, text string"))
    assert [tuple(r)[:3] for r in only.matches(docs).collect()] == [(0, 1, 1)]


def test_words_of_mixed_scripts():
    column = pa.array(["ab中文cd 中 x", None, "é中", "한글ab"])
    hashes, first = contamination.words_in(column)
    assert np.diff(first).tolist() == [6, 0, 2, 3] and hashes[1] == hashes[4] == hashes[7]


def test_blocks_agree(spark):
    """Several blocks of items find what one finds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [r["text"] for r in bench.collect()]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, f"before {t} behind") for i, t in enumerate(rows)], "doc_id long, text string"))
    one, many = (contamination.Decontaminator(docs, bench, block_items=n) for n in (500, 15))
    assert one.blocks == 1 and many.blocks > 1
    pairs = [{(r["doc_id"], r["item_id"]) for r in t.matches(docs).collect()} for t in (one, many)]
    assert pairs[0] == pairs[1] and len(pairs[0]) >= len(rows) and many.clean(docs).count() == one.clean(docs).count()


def test_long_items_in_documents(spark):
    """Items of many words that stand in documents, as they are and edited, in the latent space of all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    texts = [r["text"].split() for r in docs.where("length(text) > 4500").orderBy("doc_id").limit(60).collect()]
    texts = [t for t in texts if len(t) >= 600]
    items, rows = [], []
    for j, n in enumerate((100, 200, 500)):
        for k in range(3):
            i, words = 10_000 + 10 * j + k, texts[3 * j + k][40 : 40 + n]
            items.append((i, " ".join(words)))
            edited = [w for x, w in enumerate(words) if x % 7]
            host = texts[9 + k][:150]
            rows += [(10**6 + i, " ".join(host + words)), (2 * 10**6 + i, " ".join(host[:75] + edited + host[75:]))]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    tool = contamination.Decontaminator(docs, bench.unionByName(spark.createDataFrame(items, bench.schema)))
    got = {(r["doc_id"], r["item_id"]) for r in tool.matches(docs.where(f"doc_id > {10**6}")).collect()}
    assert {(d, d % 10**6) for d, _ in rows} <= got


def accepted(items, k, words):
    """By brute force over every stretch: whether the words hold item k."""
    own, n = items.words[k], len(items.words[k])
    tail = own[items.answer[k] :]
    ends = {w: sum(1 << i for i, x in enumerate(tail) if x == w) for w in tail}
    for s in range(max(1, len(words) - (n + n // 4 + 2) + 1)):
        part = words[s : s + n + n // 4 + 2]
        length = contamination.common_subsequence(items.masks[k], n, part)
        if length >= 0.8 * n or (length >= 0.65 * n and contamination.common_subsequence(ends, len(tail), part) >= 0.9 * len(tail)):
            return True
    return False


def test_recall_of_edited_items_by_length(spark):
    """Items of 4 to 59 words, some words dropped or replaced, in real documents: 0.9 of each length are found."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()
    cut = [(4, 5, 6, 7, 9, 12, 16, 24, 32, 99)[j % 10] for j in range(len(rows))]
    texts = {r["item_id"]: " ".join(r["text"].split()[:n]) for r, n in zip(rows, cut, strict=True)}
    tool = contamination.Decontaminator(docs, spark.createDataFrame(list(texts.items()), "item_id long, text string"))
    tool = next(tool.screens())
    hosts = [r["text"].split() for r in docs.where("length(text) > 1500").orderBy("doc_id").collect()]
    rng, items, stat = np.random.default_rng(3), tool.items, {}
    for k, i in enumerate(items.ids):
        words, n = texts[i].split(), len(items.words[k])
        for share, whole in ((0.7, True), (0.8, False), (0.85, False), (0.85, False)):
            host = hosts[int(rng.integers(len(hosts)))]
            free = len(words) - ((n - items.answer[k]) if whole and items.answer[k] else 0)
            gone = set(rng.permutation(free)[: round((1 - share) * len(words))].tolist())
            edited = [host[int(rng.integers(len(host)))] if x in gone else w for x, w in enumerate(words) if x not in gone or rng.random() < 0.5]
            at = int(rng.integers(len(host)))
            column = pa.array([" ".join(host[:at] + edited + host[at:])])
            before = len(contamination.words_in(pa.array([" ".join(host[:at])]))[0])
            if accepted(items, k, contamination.words_in(column)[0][max(0, before - 2 * n) : before + 3 * n].tolist()):
                got = stat.setdefault((n if n < 8 else 8 if n < 12 else 12 if n < 25 else 25), [0, 0])
                got[0] += any(m[1] == i for m in tool.matches(column))
                got[1] += 1
    assert len(stat) >= 6 and all(hit >= 0.9 * of for hit, of in stat.values()), stat


def test_fitted_on_every_passage(spark):
    """In the latent basis the products of all 60,000 passages are diagonal, so none is left out of the fit."""
    words = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat(F.lit("w"), F.least(F.pmod(F.xxhash64("id", j), F.lit(40)), F.pmod(F.xxhash64(j, "id"), F.lit(40)))))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    bench = spark.createDataFrame([(i, " ".join(f"w{(7 * i + j) % 40}" for j in range(12))) for i in range(10)], "item_id long, text string")
    screen = next(contamination.Decontaminator(docs, bench, rank=8).screens())
    hashes, first = contamination.words_in(docs.select("text").toArrow().column(0).combine_chunks())
    x = np.zeros((60_000, 40))
    x[np.repeat(np.arange(60_000), np.diff(first)), np.searchsorted(screen.items.vocabulary, hashes)] = 1
    idf = np.log((1 + len(x)) / (1 + x.sum(0))) + 1e-6
    x, own = x * idf, screen.items.matrix(idf)
    x, own = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, own))
    latent = screen.weighted / idf[:, None]
    got = latent.T @ (x.T @ x + own.T @ own) @ latent
    assert np.abs(got - np.diag(np.diag(got))).max() < 1e-4 * np.diag(got).min()
    best = np.linalg.eigvalsh(x.T @ x + own.T @ own)[::-1][:8]
    assert np.diag(got).sum() > 0.97 * best.sum()


def test_sums_of_many_tasks(spark):
    """More parts than are added at a time."""
    rows = spark.range(0, 300, 1, 300).mapInArrow(lambda batches: (contamination.numbered(j, np.full(3, i + j, np.float32)) for b in batches for i in b.column(0).to_pylist() for j in (1, 0)), contamination.SUMS)
    assert [t.tolist() for t in contamination.totals(rows, 300, np.float32)] == [[44850.0] * 3, [45150.0] * 3]


def test_terms_spread_as_they_are_summed():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 20, 900)
    term = np.concatenate([np.sort(rng.permutation(np.arange(50) ** 2)[:n]) for n in size]).astype(np.uint16)
    heads, table = np.cumsum(size) - size, rng.standard_normal((900, 7))
    out, want = np.zeros((2500, 7)), np.zeros((2500, 7))
    contamination.spread(term, heads, table, out)
    np.add.at(want, term, np.repeat(table, size, axis=0))
    assert np.allclose(out, want)


def test_short_items_fill_one_block(spark):
    """Blocks go by the pieces that items really have."""
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    assert contamination.Decontaminator(bench, bench).blocks == 1
    long = spark.createDataFrame([(i, "word " * 64 * 32) for i in range(-5, 0)], "item_id long, text string")
    assert contamination.Decontaminator(bench, long.unionByName(bench)).blocks == 2


def test_no_stage_draws_a_sample(spark, edges, monkeypatch):
    """The pipeline's decontamination reads all rows; nothing draws some of them."""

    def drawn(*_, **__):
        raise AssertionError("a sample")

    for owner, name in ((F, "rand"), (F, "randn"), (type(edges), "sample"), (type(edges), "sampleBy")):
        monkeypatch.setattr(owner, name, drawn)
    assert corpus_pipeline.decontaminated(spark, edges, DATA).count() == edges.count()


def test_workers_return_free_memory():
    """What a task has freed between objects that stay isn't held by its idle worker."""

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    held = [bytearray(50_000) for _ in range(4000)]
    del held[1:-1]
    before = resident()
    common.released()
    assert before - resident() > 100_000_000
