"""Quality rules with cutoffs certified on labelled documents. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, words_of

#: Counted as symbols (fixed values).
SYMBOLS = "[#*$%&|<>]"
#: Rule scores are whole bins of a twentieth; the last holds all scores of 1 and more.
BINS = 20


def ordered_windows(hashes: Column) -> Column:
    """The windows as (hash, position) in order of their hashes, or null if no hash occurs twice."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """Counts of each whole text: k, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shout.

    A null text has no words and no lines. Windows are compared by a 64-bit hash of their three words. With
    ``carry`` each row also has the document itself, as the struct ``row``.
    """
    held = [F.struct(*docs.columns).alias("row")] if carry else []
    kept = ["row"] if carry else []
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*held, F.col(key).alias("k"), F.col(stratum).alias("stratum"), body.alias("t"), words_of(F.col(text)).alias("w"))
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(0), n - F.lit(3)), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    b = a.select(
        *kept, "k", "stratum", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z!]+", "")).cast("long").alias("n_shout"),
        lines.alias("lines"), F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    c = b.select(*kept, "k", "stratum", "n_words", "word_chars", "n_symbols", "n_shout", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), ordered_windows(F.col("h")).alias("s"))
    like = lambda x, i: F.coalesce(F.get("s", i)["h"] == x["h"], F.lit(False))
    positions = F.sort_array(F.transform(F.filter("s", lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"]))
    d = c.withColumn("p", positions).drop("s")
    # a window at p covers p, p + 1 and p + 2; those up to the last window's end are counted already
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def rule_bin() -> Column:
    """The worst of four shares, as a bin: symbols a word, repeated lines, repeated words, capitals and marks."""
    exact = lambda part, whole: F.expr(f"CASE WHEN {whole} > 0 THEN ({BINS} * {part}) DIV {whole} ELSE 0 END")
    return F.least(F.lit(BINS), F.greatest(exact("n_symbols", "n_words"), exact("n_dup_lines", "n_lines"), exact("n_repeat_words", "n_words"), exact("n_shout", "word_chars"))).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X binomial of n trials at ``risk``, summed term by term in logarithms."""
    first = n.cast("double") * F.lit(math.log1p(-risk))
    odds = math.log(risk) - math.log1p(-risk)

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double") / i) + F.lit(odds)
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["total"] - top) + F.exp(term - top))).alias("total"))

    return F.when(k <= 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.struct(first.alias("term"), first.alias("total")), step, lambda s: F.exp(s["total"])))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", risk: float = 0.01, miss: float = 0.05, harm: float = 20.0) -> DataFrame:
    """For each stratum the bin from which documents are rejected: columns stratum, cut.

    Among good labelled documents that pass the base rules, a cutoff's rejections are binomial. The
    hypothesis "it rejects more than ``risk`` of them" is refuted when the exact tail P(X <= rejected) is at
    most ``miss`` divided by the number of cutoffs tried over all strata (Bonferroni). Of the refuted ones
    the cutoff with the largest share of bad documents rejected less ``harm`` times that of good ones is
    taken, the higher of equals. With probability 1 - miss no stratum then rejects more than ``risk`` of its
    good documents. A stratum without a certified cutoff has no row and rejects nothing.
    """
    marks = labels.select(F.col(key).alias("k"), F.col(label).alias("q")).where("q IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.min("q").alias("q"))
    judged = measured.where("NOT base_failed").select("k", "stratum", F.col("rule_bin").alias("bin")).join(marks, "k")
    counts = judged.groupBy("stratum", "bin").agg(F.count_if(F.col("q") > 0).alias("good"), F.count_if(F.col("q") <= 0).alias("bad"))
    # bins that hold no labelled document reject what the next higher one does
    whole = Window.partitionBy("stratum")
    above = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tried = counts.select("stratum", "bin", F.sum("good").over(above).alias("k_good"), F.sum("bad").over(above).alias("k_bad"), F.sum("good").over(whole).alias("n_good"), F.sum("bad").over(whole).alias("n_bad")).where("bin > 0")
    strata = judged.select("stratum").distinct().count()
    level = miss / max(1, strata * BINS)
    possible = tried.where(F.col("k_good") < F.col("n_good") * F.lit(risk))
    sure = possible.where(binomial_tail(F.col("n_good"), F.col("k_good"), risk) <= F.lit(level))
    worth = F.when(F.col("n_bad") > 0, F.col("k_bad") / F.col("n_bad")).otherwise(F.lit(0.0)) - F.lit(harm) * F.col("k_good") / F.col("n_good")
    return sure.groupBy("stratum").agg(F.max_by("bin", F.struct(worth.alias("v"), F.col("bin").alias("b"))).alias("cut"))


def with_rules(measured: DataFrame) -> DataFrame:
    return measured.withColumn("rule_bin", rule_bin()).withColumn("base_failed", base_failed())


def cuts_of(docs: DataFrame, labels: DataFrame, key: str, text: str, stratum: str, most_strata: int = 10_000, **how) -> tuple[DataFrame, DataFrame]:
    """(counts of each document, kept in the shared folder; the certified cutoffs).

    The cutoffs are one row for each stratum that has one, broadcast if they are at most ``most_strata`` rows.
    """
    rows = docs.count()
    measured = saved(with_rules(metrics(docs, key, text, stratum)), rows, slow=True)
    cuts = saved(certified_cutoffs(measured, labels, key, **how).select(F.col("stratum").alias("s"), "cut"), rows)
    return measured, F.broadcast(cuts) if cuts.count() <= most_strata else cuts


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    out = measured.join(cuts, measured["stratum"].eqNullSafe(cuts["s"]), "left").withColumn("cut", F.coalesce("cut", F.lit(BINS + 1)).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule_bin") < F.col("cut")))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """Counts of each document, base_failed and kept.

    A document is kept if it passes the base rules and its rule bin is under its stratum's certified cutoff.
    Null and empty texts have no words and fail. A null stratum is one of its own. Repeated rows are judged
    alike, each with its row; an empty table gives none; without labels only the base rules reject. Other
    columns are not read.
    """
    out = verdicts(*cuts_of(docs, labels, key, text, stratum, **how))
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bin", "cut")


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; each row by its own text.

    Once the cutoffs are known, a row's counts are taken again beside it: so whole rows are neither shuffled nor
    stored in between. The counts stand behind a column that isn't deterministic, or else Spark would move the
    filter below them and repeat their expressions in it many times over.
    """
    _, cuts = cuts_of(docs, labels, key, text, stratum, **how)
    counted = metrics(docs, key, text, stratum, carry=True).withColumn("nth", F.monotonically_increasing_id())
    return verdicts(with_rules(counted), cuts).where(F.col("kept") & (F.col("nth") >= 0)).select("row.*")
