"""Sharding, mixing, URLs, quality rules, token files."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_repeats import ordered

import re
from pathlib import Path

from glyphsift.llm import common, mixing, quality, sharding, tokens, urls

DATA = "/root/testdata/sf0.01"


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.1


def test_shards(edges, nothing):
    rows = sharding.assign(edges).collect()
    texts = sorted((k is None, k or 0, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in ordered(edges))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == texts
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 for r in rows)
    assert sharding.assign(nothing).count() == 0


def brute_targets(sizes, weights=(1, 2, 3)):
    w, out, fixed = [weights[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), {i for i, s in enumerate(sizes) if not s}
    while len(fixed) < len(sizes):
        rest = sum(sizes) - sum(out[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        for i in free:
            out[i] = rest * w[i] / sum(w[j] for j in free)
        above = [i for i in free if out[i] >= 3 * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = 3.0 * sizes[i]
        fixed |= set(above)
    return out


@pytest.mark.parametrize("sizes", [[], [0], [5], [100, 1, 1], [10, 0, 1000, 3], [7] * 10])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes))
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True)) and sum(got) == pytest.approx(sum(sizes))


def test_permutations_and_draws():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))) == list(range(n))
    counts = mixing.drawn(1000, np.ones(7), [1, 2])
    assert counts.sum() == 1000 and len(set(counts)) > 1 and counts.tolist() == mixing.drawn(1000, np.ones(7), [1, 2]).tolist()


@pytest.mark.parametrize("group", [4096, 3])
def test_mix_by_brute_force(edges, group, monkeypatch):
    """Words are taken as the slots say: the plan's rows are followed one by one."""
    monkeypatch.setattr(mixing, "GROUP", group)
    mix = mixing.Mix(edges, block=16, slots=40)
    docs, slots = mix.docs.collect(), mix.slots().collect()
    assert mix.shards > 3 and len({r["shard"] for r in slots}) > 3
    words: dict = {}  # each source's words, by the document that has them
    for r in sorted(docs, key=lambda r: r["start"]):
        own = words.setdefault(r["key"], [])
        if r["size"]:
            assert r["start"] == len(own)
            own += [(r["k"], r["chunk"], r["nth"])] * r["size"]
    taken, by_shard, times = {}, {}, {}
    for r in slots:
        length = mix.sources[r["key"]][3]
        part = words[r["key"]][r["block"] * length : (r["block"] + 1) * length]
        by_shard[r["shard"], r["key"]] = by_shard.get((r["shard"], r["key"]), 0) + len(part)
        times.setdefault((r["key"], r["block"]), []).append(r["repeat"])
        for who in part:
            n, shards = taken.get((r["key"], who), (0, set()))
            taken[r["key"], who] = n + 1, shards | {r["shard"]}
    for key, (_, n, target, length, blocks, owed) in mix.sources.items():
        each = [times.get((key, b), []) for b in range(blocks)]
        assert sum(map(len, each)) == owed and all(sorted(x) == list(range(len(x))) and owed // blocks <= len(x) <= -(-owed // blocks) <= 3 for x in each)
        assert abs(sum(t for (k, _), (t, _) in taken.items() if k == key) - target) <= 2 * length
    true = []
    for r in docs:
        n, shards = taken.get((r["key"], (r["k"], r["chunk"], r["nth"])), (0, set()))
        true.append((r["k"], r["size"], n, min(shards, default=None), max(shards, default=None)))
    got = mixing.mix_sizes(edges, block=16, slots=40).collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"], r["first_shard"], r["last_shard"]) for r in got), key=str) == sorted(true, key=str)
    assert {(r["shard"], r["key"]): r["words"] for r in mix.shard_sizes().collect()} == by_shard


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in mixing.mix_sizes(docs).collect()]
    assert rows == [r.asDict() for r in mixing.mix_sizes(docs).collect()] or sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix_sizes(docs).collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken = {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    aims = dict(zip(sorted(sizes), brute_targets([sizes[s] for s in sorted(sizes)]), strict=True))
    assert all(abs(taken[s] - aims[s]) <= 0.02 * aims[s] for s in sizes)
    assert all(r["target"] == pytest.approx(aims[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]] for r in rows)


def test_mix_edges(edges, nothing):
    rows = mixing.mix_sizes(edges, block=16).collect()
    assert len(rows) == edges.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    words = {}
    for k, t in ordered(edges):
        words.setdefault(k, []).append(len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]))
    assert all(r["size"] in words[r["doc_id"]] for r in rows)
    made = mixing.mix_texts(edges, block=16)
    assert made.columns == edges.columns
    count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert made.agg(F.sum(count)).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix_sizes(nothing).count() == mixing.mix_texts(nothing).count() == 0


URLS = [("http://a.example.net/en/1", "allow"), ("https://EXAMPLE.net/en/", "allow"), ("https://example.net/fr/1?x#y", "block"), ("http://x.net", None), ("http://example.com/de/9", "block"), ("http://www.example.org/fr/1", "allow"), ("example.org/fr/", None), ("http://notexample.com/de/", None), ("", None), (None, None), ("http://[::1", None), ("ftp://net/", "block"), ("http://a.net?q=/", None)]


def parsed(url):
    """(host, path, query), character by character."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop]), rest[stop:].partition("#")[0]
    path, _, query = rest.partition("?")
    return host, path, query


def brute_suffixes(url):
    host, path, _ = parsed(url)
    labels = host.split(".")
    return {"top": labels[-1], "domain": ".".join(labels[-2:]), "segment": path.split("/")[1] if "/" in path else ""}


def brute_features(url, stats):
    host, path, query = parsed(url)
    url = url or ""
    shares = [url.count(c) / len(url) for c in set(url)]
    known = [stats.get(x, (0.5, 0)) for x in brute_suffixes(url).items()]
    shape = (len(url), path.count("/"), sum(c in "0123456789" for c in url) / max(1, len(url)), -sum(p * math.log2(p) for p in shares), query.count("&") + 1 if query else 0, len(host), host.count(".") + 1 if host else 0, url.count("-"))
    return [*shape, *(v for share, n in known for v in (share, math.log1p(n)))]


#: More shapes: empty labels, marks in every order, other scripts, line ends, repeats, a very long one.
ODD_URLS = ["http://a..b./x", "http://./", "http://h?q", "http://h#f?q=1&r", "http://h?&&#f", "x://y://z/p?://", "http://ÄÖ.Ünet/ß-1?π=3", "http://a\nb.c\nd/e\nf?g\nh", "://", "http://", "http://t.net/a", "http://t.net/a", "http://l.net/" + "a-1/" * 20000 + "?" + "p=1&" * 5000]


def test_url_features_by_brute_force():
    every = [u for u, _ in URLS] + ODD_URLS
    blocked = np.arange(len(every)) % 3 == 0
    counts: dict = {}
    for u, bad in zip(every, blocked, strict=True):
        for part in brute_suffixes(u).items():
            counts.setdefault(part, []).append(int(bad))
    stats = urls.suffix_stats(every, blocked)
    assert stats == {k: ((sum(v) + 1) / (len(v) + 2), len(v)) for k, v in counts.items()}
    for known in (stats, dict(list(stats.items())[:5]), {}):
        assert np.allclose(urls.features(every, known), [brute_features(u, known) for u in every])
    assert urls.features([], stats).shape == (0, len(urls.FEATURES)) and urls.features([None], {}).shape == (1, len(urls.FEATURES))


def test_trees_by_brute_force():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    model = urls.BoostedTrees(trees=12).fit(x, y)

    def walked(row):
        margin = model.bias
        for *levels, leaves in model.nodes:
            node = 0
            for level in levels:
                j, cut = level[node]
                node = 2 * node + int(sum(e <= row[j] for e in model.edges[j]) > cut)
            margin += model.rate * leaves[node]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(model.score(x), [walked(r) for r in x])
    # the first split is the best of all by the gain that boosting maximises
    p = y.mean()
    def gain(left):
        g, h = (y - p) * 1.0, np.full(len(y), p * (1 - p))
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))
    best = max(gain(x[:, j] < e) for j in range(5) for e in model.edges[j] if 5 <= (x[:, j] < e).sum() <= len(y) - 5)
    j, cut = model.nodes[0][0][0]
    assert np.isclose(gain(x[:, j] < model.edges[j][cut]), best)


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, (u, _) in enumerate(URLS)], "page_id long, url string, u string, host int")
    for r in urls.judge(df).collect():
        u, said = URLS[r["page_id"]]
        host, path, _ = parsed(u)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"] is not None) == (said is not None) and (said is None or r["verdict"] == said) and r["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_trees_on_held_out_urls(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = urls.judge(pages).where("rule IS NOT NULL").select("page_id", "verdict").join(pages, "page_id").toPandas()
    blocked = (rows["verdict"] == "block").to_numpy()
    half = rows["page_id"].to_numpy() % 2 == 0
    stats = urls.suffix_stats(rows["url"][half], blocked[half])
    model = urls.BoostedTrees().fit(urls.features(rows["url"][half], stats), blocked[half].astype(float))
    right = (model.score(urls.features(rows["url"][~half], stats)) >= 0.5) == blocked[~half]
    assert right.mean() > 0.9


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, edges, documents, nothing):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for df in (edges, documents):
        got = sorted((tuple(r)[:7] for r in quality.judge(df, labels).collect()), key=str)
        assert got == sorted(((k, *brute_quality(t)) for k, t in ordered(df)), key=str)
        kept = sorted((r["doc_id"] for r in quality.judge(df, labels).where("kept").collect()), key=str)
        clean = quality.clean(df, labels)
        assert clean.columns == df.columns and sorted((r["doc_id"] for r in clean.collect()), key=str) == kept
    assert quality.judge(nothing, labels).count() == quality.clean(nothing, labels).count() == 0


def test_quality_counts_go_to_few_files(spark, edges):
    """However many tasks count, and whether keys differ or not; each file may start processes."""
    folder, coalesced = Path(common.shared_dir(spark).removeprefix("file:")), "spark.sql.adaptive.coalescePartitions.enabled"
    labels = edges.selectExpr("doc_id", "1 AS quality")
    for df in (edges, edges.withColumn("doc_id", F.lit(None).cast("long"))):
        for on in ("true", "false"):
            there, before = set(folder.iterdir()), spark.conf.get(coalesced)
            spark.conf.set(coalesced, on)
            spark.conf.set("spark.sql.shuffle.partitions", "24")
            try:
                out = quality.judge(df.repartition(30), labels)
                assert sorted((tuple(r)[:7] for r in out.collect()), key=str) == sorted(((k, *brute_quality(t)) for k, t in ordered(df)), key=str)
            finally:
                spark.conf.set(coalesced, before)
                spark.conf.set("spark.sql.shuffle.partitions", "4")
            files = [len(list(d.glob("part-*"))) for d in set(folder.iterdir()) - there]
            assert len(files) == 2 and max(files) <= 4, files


def test_binomial_tail(spark):
    rows = [(n, k) for n in (1, 50, 700) for k in (0, 1, 7, 20) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        assert r["p"] == pytest.approx(sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)))


def test_cutoffs_are_certified(spark):
    """One stratum with clean scores gets a cutoff, one with mixed scores and one with few labels get none."""
    good = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"B{i}!" * 2 for i in range(60)).upper()
    rows = [(i, good if i % 10 else bad, "clean", int(i % 10 > 0)) for i in range(2000)]
    rows += [(i + 5000, good if i % 10 else bad, "mixed", int(i % 3 > 0)) for i in range(2000)]
    rows += [(i + 9000, bad, "few", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = quality.judge(df, df.select("doc_id", "quality")).join(df, "doc_id")
    kept = {(r["lang"], r["text"] == bad): r["k"] for r in out.groupBy("lang", "text").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept["clean", False] == 1 and kept["clean", True] == 0
    assert kept["mixed", True] == kept["few", True] == 1


def test_token_round_trip(spark, edges, nothing, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    edges = edges.union(edges.limit(1).selectExpr("CAST(21 AS LONG)", "'an <|endoftext|> inside, and one<|endoftext|>behind'", *edges.columns[2:]))
    folder = str(tmp_path / "out")
    manifest = tokens.write(edges, folder, path, part_bytes=20_000)
    assert len(manifest["parts"]) > 2
    rows = ordered(edges)
    true = [(k, plain.encode(t, add_special_tokens=False).ids + [2]) for k, t in rows]
    assert [(k, ids.tolist()) for k, ids in tokens.documents(folder, manifest)] == true
    got = sorted(tokens.read(spark, folder, manifest).collect(), key=lambda r: r["start"])
    start = 0
    for r, (k, ids) in zip(got, true, strict=True):
        assert tuple(r) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.round_trip(nothing, path, str(tmp_path / "none")).count() == 0


def test_chunks_are_whole_encodings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, plain = tokens.ChunkEncoder(path, "<u2", 2), Tokenizer.from_file(path)
    texts = ["a  b", "\n", "", " ", " x", "x ", "a\n b", "a\tb", "l'l 's don't.", "<|endoftext|> a", "word, word. word! word", "a\x85b c", "a\x1cb", "é., ñ;:", "x" * 3000, "123, 4.5", "a\n\nb", "foo \nbar", "tail...\nhead,,, ", "<|endoftext|>", "a <|endoftext|>.", "\nword", "\u3000x", "x\u2028y", "…! don't.", " ,", "\n,", "a\n,.", None]
    true = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    tokens.REMEMBERED, kept = 3, tokens.REMEMBERED
    try:
        for group in (texts, texts[::-1], texts[5:9], texts[:1], texts[1:2], texts):
            ids, counts = e.encode(pa.array(group, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [true[texts.index(t)] for t in group]
    finally:
        tokens.REMEMBERED = kept
    assert len(e.encode(pa.array([], pa.string()))[0]) == 0
