"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, mixed, saved, words_of

WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights=WEIGHTS, most: int = 3) -> list[float]:
    """Each source's share of the words of all, by repeating weights, none above ``most`` times its size.

    What a source cannot take is shared out again by weight among the others, until none is above.
    """
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, fixed = np.zeros(len(size)), size == 0
    while not fixed.all():
        rest = size.sum() - out[fixed].sum()
        out[~fixed] = rest * weight[~fixed] / weight[~fixed].sum()
        above = ~fixed & (out >= most * size)
        if not above.any():
            break
        out[above] = most * size[above]
        fixed |= above
    return out.tolist()


#: Shards that one draw is over; more are drawn in two steps, groups of shards first.
GROUP = 4096


def drawn(owed: int, shares: np.ndarray, seed: list[int]) -> np.ndarray:
    """A multinomial draw of ``owed`` blocks over shards (or groups of them) by their shares."""
    return np.random.default_rng(seed).multinomial(owed, shares / shares.sum())


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of [0, size) at ``index``, by a four-round Feistel network with cycle walking."""
    index, size, seed = (np.asarray(v).astype(np.uint64) for v in (index, size, seed))
    half = np.ones(len(size), np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < size).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(live):
            h, m, s = half[live], mask[live], seed[live]
            left, right = out[live] >> h, out[live] & m
            for r in range(4):
                left, right = right, left ^ (mixed(right ^ mixed(s + np.uint64(r * 0x9E3779B9))) & m)
            out[live] = (left << h) | right
            live = live[out[live] >= size[live]]
    return out.astype(np.int64)


def source_key(source: Column) -> Column:
    """A key that tells a null source from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def text_mark(text: Column) -> Column:
    """A 64-bit hash of the text, to tell rows of one key apart."""
    return F.xxhash64(text)


class Mix:
    """The plan of one mix.

    docs: k, key, source, size, start (words of its source before it); blocks of a source are its words
    [i * block, (i + 1) * block), the last one shorter. sources: key -> (position, size, target, block, blocks,
    owed). A source of under 64 blocks gets shorter ones, so that rounding its target to blocks moves it little.

    Each source owes the blocks of its target, so that no draw moves a source off its target. How many of them
    go to which output shard is drawn: independent draws for each source over equal shards are, given the
    shards' totals, multinomial draws of each shard's source counts by the target weights. So a source's draw
    needs no other's, and tasks make them.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = 128, slots: int = 1024, seed: int = 7, weights=WEIGHTS, most: int = 3, most_sources: int = 100_000):
        self.spark, self.block, self.seed, self.key = docs.sparkSession, block, seed, key
        body = F.coalesce(F.col(text), F.lit(""))
        named = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), source_key(F.col(source)).alias("key"), F.regexp_count(body, F.lit(WORD_PATTERN)).cast("long").alias("size"), text_mark(F.col(text)).alias("mark"))
        # rows of one key (repeated rows) follow each other; "nth" tells them apart
        sized = saved(named)
        chunks = max(256, -(-sized.count() // 50_000))
        sized = sized.withColumn("chunk", F.pmod(F.xxhash64("k", "mark"), F.lit(chunks)))
        by_chunk = saved(sized.groupBy("key", "chunk").agg(F.sum("size").alias("n")))
        totals = by_chunk.groupBy("key").agg(F.sum("n").alias("n")).limit(most_sources + 1).collect()
        if len(totals) > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        totals.sort(key=lambda r: (r["key"][0] == "n", r["key"]))
        sizes = [int(r["n"]) for r in totals]
        aims = targets(sizes, weights, most)
        self.sources = {}
        for i, (r, n, aim) in enumerate(zip(totals, sizes, aims, strict=True)):
            length = max(1, min(block, n // 64))
            blocks = -(-n // length)
            owed = min(most * blocks, round(aim * blocks / n)) if n else 0
            self.sources[r["key"]] = (i, n, aim, length, blocks, owed)
        self.shards = max(1, -(-sum(s[-1] for s in self.sources.values()) // slots))
        lengths = self.spark.createDataFrame([(k, v[3]) for k, v in self.sources.items()], "key string, block_words long")
        bases = by_chunk.select("key", "chunk", (F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")).alias("base"))
        inside = Window.partitionBy("key", "chunk").orderBy("k", "size", "mark")
        placed = sized.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(inside))
        self.docs = placed.join(bases, ["key", "chunk"]).join(F.broadcast(lengths), "key").select("k", "key", "chunk", "nth", "source", "size", "mark", "block_words", (F.col("base") + F.coalesce("before", F.lit(0))).alias("start"))

    def slots(self) -> DataFrame:
        """One row for each block of the output: shard, key, block, repeat (how often the block came before)."""
        shards, seed_, groups = self.shards, self.seed, -(-self.shards // GROUP)
        kind = pa.schema([("group", pa.int32()), ("shard", pa.int64()), ("key", pa.string()), ("i", pa.int32()), ("blocks", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])

        def spread(r: dict, counts: np.ndarray, shard0: int, group: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            same = lambda c: [r[c]] * len(at)
            return pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array(shard0 + at), pa.array(same("key"), pa.string()), pa.array(same("i"), pa.int32()), pa.array(same("blocks"), pa.int64()), pa.array(r["first"] + np.cumsum(counts)[at] - counts[at]), pa.array(counts[at])], schema=kind)

        def by_group(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    sizes = np.full(groups, GROUP)
                    sizes[-1] = shards - GROUP * (groups - 1)
                    yield spread(r, drawn(r["n"], sizes, [seed_, r["i"]]), 0, np.arange(groups))

        def by_shard(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    first = r["group"] * GROUP
                    yield spread(r, drawn(r["n"], np.ones(min(GROUP, shards - first)), [seed_, r["i"], r["group"]]), first, np.full(GROUP, r["group"]))

        owing = self.spark.createDataFrame([(0, 0, k, i, blocks, 0, owed) for k, (i, _, _, _, blocks, owed) in self.sources.items()], "group int, shard long, key string, i int, blocks long, first long, n long")
        text = "group int, shard long, key string, i int, blocks long, first long, n long"
        tasks = max(1, min(200, self.shards * len(self.sources) // 16))
        plan = owing.mapInArrow(by_group, text).repartition(tasks, "group", "i").mapInArrow(by_shard, text).repartition(tasks, "shard", "i")
        seed = self.seed

        @F.pandas_udf("long")
        def block_at(i: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
            # each pass over a source has a permutation of its own
            keys = mixed((np.uint64(seed) << np.uint64(40)) ^ (i.to_numpy(np.uint64) << np.uint64(8)) ^ (slot // blocks).to_numpy(np.uint64))
            return pd.Series(permuted((slot % blocks).to_numpy(), blocks.to_numpy(), keys))

        each = plan.select("shard", "key", "i", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - F.lit(1))).alias("slot"))
        return each.select("shard", "key", block_at("i", "slot", "blocks").alias("block"), F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("repeat"))

    def pieces(self) -> DataFrame:
        """Which words of each document lie in which block: [begin, stop) counted in the document."""
        b = F.col("block_words")
        end = F.col("start") + F.col("size")
        spread = self.docs.where("size > 0").select("k", "chunk", "nth", "key", "start", "block_words", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - F.lit(1)) / b))).alias("block"))
        return spread.select("k", "chunk", "nth", "key", "block", (F.greatest("start", F.col("block") * b) - F.col("start")).alias("begin"), (F.least("end", (F.col("block") + F.lit(1)) * b) - F.col("start")).alias("stop"))

    def joined(self) -> DataFrame:
        """Each piece once for each time that the mix takes its block."""
        return self.pieces().join(self.slots().select("key", "block", "repeat").hint("merge"), ["key", "block"])

    def shard_sizes(self) -> DataFrame:
        """The words of each source in each output shard: shard, key, words."""
        return self.pieces().join(self.slots().select("shard", "key", "block").hint("merge"), ["key", "block"]).groupBy("shard", "key").agg(F.sum(F.col("stop") - F.col("begin")).alias("words"))


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size (words), source_size, target (words, its source's), taken, and first_shard and last_shard,
    the least and largest output shard that has words of it (null if none has). Sources go by code point, null last; see ``targets``. A null or empty text has size 0 and gives nothing. Repeated rows
    count as documents of their own. An empty table gives no rows. Sources of no words have target 0.
    The same table and seed give the same mix.
    """
    mix = Mix(docs, **how)
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, v[1], float(v[2])) for k, v in mix.sources.items()], "key string, source_size long, target double")
    used = mix.slots().groupBy("key", "block").agg(F.count("*").alias("times"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    taken = mix.pieces().join(used.hint("merge"), ["key", "block"]).groupBy("k", "chunk", "nth", "key").agg(F.sum((F.col("stop") - F.col("begin")) * F.col("times")).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("k", "chunk", "nth", "key")]
    out = mix.docs.alias("d").join(taken.alias("t").hint("merge"), same[0] & same[1] & same[2] & same[3], "left").select("d.k", "d.key", "d.size", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"), "t.first_shard", "t.last_shard")
    return out.join(F.broadcast(known), "key").select(F.col("k").alias(mix.key), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mix_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix as documents: all columns of ``docs``, a row for each document and repeat of which words are taken.

    The text holds the taken words of that repeat in order, joined by one space; a document taken whole keeps
    its text as it is. Documents without words aren't taken. Rows that agree in key, source and number of
    words are told apart by their text; rows that agree in that too give equal rows. An empty table gives none.
    """
    columns, source = docs.columns, how.get("source", "source")
    mix = Mix(docs, key=key, text=text, **how)
    pieces = mix.joined().groupBy("k", "chunk", "nth", "key", "repeat").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("cuts"), F.sum(F.col("stop") - F.col("begin")).alias("n"))
    sized = mix.docs.select("k", "chunk", "nth", "key", "size", "mark")
    names = ("k", "chunk", "nth", "key")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in names]
    row_id = F.xxhash64("k", "key", "mark")
    # rows that agree in key, source and text are numbered on both sides, and each takes the cuts of one
    ranked = sized.withColumn("id", row_id).withColumn("same", F.row_number().over(Window.partitionBy("id").orderBy("nth")))
    taken = pieces.alias("p").join(ranked.alias("s").hint("merge"), same[0] & same[1] & same[2] & same[3]).select("s.id", "s.same", "s.size", "p.cuts", "p.n")
    t = f"c{columns.index(text)}"
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.withColumn("id", F.xxhash64(F.col(f"c{columns.index(key)}"), source_key(F.col(f"c{columns.index(source)}")), text_mark(F.col(t)))).withColumn("same", F.row_number().over(Window.partitionBy("id").orderBy("id")))
    # the numbers are compared by their difference, so that the join keeps the texts where the numbering put them
    both = rows.alias("d").join(taken.alias("t").hint("merge"), (F.col("d.id") == F.col("t.id")) & (F.col("d.same") - F.col("t.same") == 0))
    words = F.col("w")
    cut = F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(words, (c["begin"] + 1).cast("int"), (c["stop"] - c["begin"]).cast("int")))), " ")
    made = both.select(*[f"d.c{i}" for i in range(len(columns))], "t.n", "t.size", "t.cuts").withColumn("w", F.when(F.col("n") < F.col("size"), words_of(F.col(t)))).withColumn("made", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col(t)))
    return made.select(*[F.col("made" if c == text else f"c{i}").alias(c) for i, c in enumerate(columns)])
