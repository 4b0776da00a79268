"""Toxicity, decontamination and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from glyphsift.llm import contamination, toxicity

DATA = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    categories = {"low_quality": F.when(F.col("quality") == 0, 1).otherwise(0), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"), categories)
    test = labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("true"))
    rows = toxicity.score(docs.join(test.select("doc_id"), "doc_id"), chain, list(categories)).join(test, "doc_id").toPandas()
    # some English texts are labelled toxic without any of its words
    hit, true = rows["toxic"].to_numpy(bool), rows["true"].to_numpy() == 1
    assert (hit & true).sum() / true.sum() > 0.85 and (hit & ~true).sum() / (~true).sum() < 0.01


def test_toxicity_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(edges, none, {"toxic": F.col("toxic")}) is None
    assert toxicity.score(edges, None, ["toxic"]).where("toxic").count() == 0
    labels = spark.createDataFrame([(i, int(i in (7, 8, 9))) for i in range(21)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.train(edges, labels, {"toxic": F.col("toxic")})
    assert toxicity.score(edges, chain, ["toxic"]).count() == edges.count()
    assert toxicity.score(nothing, chain, ["toxic"]).count() == 0


def test_linear_chain():
    rng = np.random.default_rng(0)
    rows, words, y = [], [], []
    for i in range(600):
        a, b = rng.random() < 0.3, rng.random() < 0.5
        rows += [i] * 3
        words += [int(rng.integers(100, 400)), 1 if a else 2, 3 if b else 4]
        y.append((a, a and b))
    order = np.argsort(rows, kind="stable")
    chain = toxicity.Chain().fit(np.array(rows)[order], np.array(words, np.uint64)[order], np.array(y, float), np.arange(600) % 5)
    odds = chain.score(np.array(rows), np.array(words, np.uint64), 600)
    assert ((odds[:, 0] >= chain.cuts[0]) == np.array(y)[:, 0]).mean() > 0.99
    assert ((odds[:, 1] >= chain.cuts[1]) == np.array(y)[:, 1]).mean() > 0.95


def test_leaks_are_found(spark):
    """Recall against brute force: every document that holds an item's text."""
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r["text"] for r in bench.collect()]
    true = {r["doc_id"] for r in docs.collect() if r["text"] and any(t in r["text"] for t in items)}
    found = {r["doc_id"] for r in contamination.Decontaminator(docs, bench).matches(docs).collect()}
    assert len(found & true) >= 0.9 * len(true) and len(found - true) <= 2


def test_paraphrases_and_edges(spark, edges, nothing):
    rng = np.random.default_rng(2)
    item = [f"question{i}" for i in range(24)]
    near = list(item)
    for i in (3, 9, 15):
        near[i] = "changed"
    filler = lambda n: " ".join(f"f{rng.integers(0, 3000)}" for _ in range(n))
    rows = [(100, filler(90) + " " + " ".join(near) + " " + filler(70)), (101, filler(200)), (102, " ".join(rng.permutation(item)) + " " + filler(50)), (103, None), (104, ""), (100, " ".join(item))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").unionByName(edges.select("doc_id", "text", F.lit("y").alias("word")))
    tool = contamination.Decontaminator(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in tool.matches(df).collect()} == {(100, 1)}
    clean = tool.clean(df)
    assert clean.columns == df.columns and clean.count() == df.count() - 2
    assert contamination.Decontaminator(nothing, bench).matches(nothing).count() == 0
    assert contamination.Decontaminator(edges, bench.limit(0)).clean(edges).count() == edges.count()


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (rng.integers(0, 6, int(rng.integers(1, 40))).tolist() for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        mask: dict = {}
        for i, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << i
        assert contamination.common_subsequence(mask, len(a), b) == table[-1, -1]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    good = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert good.columns == docs.columns
    short = {r["doc_id"] for r in docs.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) < 50).collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert not kept & short and len(kept) > 0.5 * docs.count()
    sample = good.where("doc_id < 150")
    one = corpus_pipeline.near_duplicates(spark, sample, DATA)
    from test_jaccard import brute
    from test_repeats import ordered

    assert {r["doc_id"] for r in one.collect()} == {key for key, _, c in brute(ordered(sample)) if key == c}
    assert one.columns == docs.columns
    clean = corpus_pipeline.decontaminated(spark, one, DATA)
    assert clean.columns == docs.columns and clean.count() <= one.count()
    mix = corpus_pipeline.mixed(spark, clean, DATA)
    assert mix.columns == docs.columns and set(r["doc_id"] for r in mix.collect()) <= set(r["doc_id"] for r in clean.collect())


def test_stages_on_edges(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "shard" in out.columns
