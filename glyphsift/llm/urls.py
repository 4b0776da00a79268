"""URL rules, and a gradient-boosted verdict on lexical features where no rule fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of rules of one length the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda x: len(x[1])):  # the last one wrapped is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == F.lit(name)) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


#: What comes before the host, the host, the path and the query of a url.
PARTS = r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)(?P<query>\?[^#]*)?"
#: What statistics are kept of: the host's last label, its last two, and the first part of the path.
SUFFIXES = {"top": ("host", r"(?s)(?P<x>[^.]*)$"), "domain": ("host", r"(?s)(?P<x>(?:[^.]*\.)?[^.]*)$"), "segment": ("path", r"(?s)^/(?P<x>[^/]*)")}


def parts(urls: pa.Array) -> dict[str, pa.Array]:
    """Host, path and query of each url as in the column functions; the query without its ``?``."""
    found = pc.extract_regex(urls, PARTS)
    host, path, query = (pc.struct_field(found, k).fill_null("") for k in ("host", "path", "query"))
    return {"host": pc.ascii_lower(host), "path": path, "query": pc.utf8_slice_codeunits(query, 1)}


def suffixes(of: dict[str, pa.Array]) -> dict[str, pa.Array]:
    return {k: pc.struct_field(pc.extract_regex(of[part], pattern), "x").fill_null("") for k, (part, pattern) in SUFFIXES.items()}


def entropies(texts: pa.Array) -> np.ndarray:
    """Bits per character of each text; none in an empty one."""
    row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    point = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    cell, n = np.unique(row * 0x110000 + point, return_counts=True)
    row = cell // 0x110000
    size = np.bincount(row, n, len(texts))
    share = n / size[row]
    return np.bincount(row, -share * np.log2(share), len(texts))


FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "labels", "hyphens", "top_rate", "top_count", "domain_rate", "domain_count", "segment_rate", "segment_count")


def as_texts(urls) -> pa.Array:
    """A null url is one with nothing in it."""
    return pa.array(urls, pa.large_string(), from_pandas=True).fill_null("")


def features(urls, stats: dict) -> np.ndarray:
    """Rows of FEATURES, a column at a time. A suffix without statistics counts as half blocked, never seen."""
    texts = as_texts(urls)
    of = parts(texts)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    count = lambda x, c: number(pc.count_substring(x, c))
    length, host_length = number(pc.utf8_length(texts)), number(pc.utf8_length(of["host"]))
    digits = number(pc.count_substring_regex(texts, "[0-9]"))
    parameters = np.where(number(pc.binary_length(of["query"])) > 0, count(of["query"], "&") + 1, 0)
    out = [length, count(of["path"], "/"), digits / np.maximum(1, length), entropies(texts), parameters, host_length, np.where(host_length > 0, count(of["host"], ".") + 1, 0), count(texts, "-")]
    for kind, values in suffixes(of).items():
        known = [(x, v) for (k, x), v in stats.items() if k == kind]
        table = np.array([*(v for _, v in known), (0.5, 0)], float)
        at = pc.index_in(values, pa.array([x for x, _ in known], pa.large_string())).fill_null(len(known))
        share, n = table[at.to_numpy(zero_copy_only=False)].T
        out += [share, np.log1p(n)]
    return np.stack(out, axis=1)


def suffix_stats(urls, blocked: np.ndarray, most: int = 4096) -> dict:
    """Smoothed share of blocked URLs for the most frequent suffixes and path beginnings: (share, count)."""
    seen: dict = {}
    for kind, values in suffixes(parts(as_texts(urls))).items():
        code = values.dictionary_encode()
        at, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
        bad, n = np.bincount(at, blocked, len(names)), np.bincount(at, minlength=len(names))
        seen |= {(kind, x): (int(b), int(c)) for x, b, c in zip(names, bad, n, strict=True)}
    kept = sorted(seen.items(), key=lambda x: (-x[1][1], x[0]))[:most]
    return {k: ((bad + 1) / (n + 2), n) for k, (bad, n) in kept}


class BoostedTrees:
    """Logistic gradient boosting over histograms of at most ``bins`` values a feature."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.bias, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias, self.nodes = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-9))
            self.nodes.append(tree)
            margin += self.rate * self._walk(tree, binned)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        binned = self._binned(x)
        margin = np.full(len(x), self.bias)
        for tree in self.nodes:
            margin += self.rate * self._walk(tree, binned)
        return 1 / (1 + np.exp(-margin))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, binned, gradient, curvature) -> list:
        """A complete tree as levels of (feature, bin) and then leaf values."""
        node, levels = np.zeros(len(binned), np.int64), []
        for level in range(self.depth):
            split = np.zeros((1 << level, 2), np.int64)
            split[:, 1] = self.bins
            best = np.full(1 << level, 1e-9)
            for j in range(binned.shape[1]):
                cell = node * self.bins + binned[:, j]
                g, h, n = (np.bincount(cell, w, (1 << level) * self.bins).reshape(-1, self.bins).cumsum(1) for w in (gradient, curvature, None))
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(n < self.least) | (n[:, -1:] - n < self.least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(len(top)), top] > best
                best[better], split[better, 0], split[better, 1] = gain[np.arange(len(top)), top][better], j, top[better]
            levels.append(split)
            node = node * 2 + (binned[np.arange(len(node)), split[node, 0]] > split[node, 1])
        g, h = (np.bincount(node, w, 1 << self.depth) for w in (gradient, curvature))
        return [*levels, g / (h + 1)]

    def _walk(self, tree: list, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for split in tree[:-1]:
            node = node * 2 + (binned[np.arange(len(node)), split[node, 0]] > split[node, 1])
        return tree[-1][node]


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict", most_rows: int = 20_000) -> tuple[BoostedTrees | None, dict, str]:
    """(model, suffix statistics, verdict without a model) from labelled URLs.

    ``most_rows`` bounds what the driver gathers: the rows whose url has the least hash. Of one class only,
    or without rows, there is no model and the third value holds for every url.
    """
    rows = labelled.where(F.col(verdict).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(verdict).alias("verdict"))
    share = min(1.0, 1.5 * most_rows / max(1, rows.count()))  # so that few rows beyond the bound are sorted
    near = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    sample = near.orderBy(F.pmod(F.xxhash64("url"), F.lit(1 << 30)), "url", "verdict").limit(most_rows).toPandas()
    blocked = (sample["verdict"] == "block").to_numpy(bool)
    if not len(sample) or blocked.all() or not blocked.any():
        return None, {}, "block" if len(sample) and blocked.all() else "allow"
    stats = suffix_stats(sample["url"], blocked)
    return BoostedTrees().fit(features(sample["url"], stats), blocked.astype(float)), stats, "allow"


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", most_rows: int = 20_000) -> DataFrame:
    """Each url's host, path, the rule that fits, and its verdict: the rule's, else the trees'.

    The trees learn from the urls that a rule labels. ``block_score`` is null where a rule decides. A null
    url, an empty one or one without ``://`` has an empty host and path, fits no rule and is judged like any
    other, very long ones as a whole. Repeated rows each keep their row and are judged alike; an empty table
    gives none. Other columns are not read, whatever their names.
    """
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).select("k", "u", host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = base.select("*", rule.alias("rule"), said.alias("said"))
    model, stats, otherwise = train(ruled, "u", "said", most_rows)

    @F.pandas_udf("double")
    def scored(urls: pd.Series, ruled: pd.Series) -> pd.Series:
        out = np.full(len(urls), np.nan)
        asked = np.flatnonzero(ruled.isna())  # Spark calls this for all rows, whatever stands around it
        out[asked] = model.score(features(urls.iloc[asked], stats)) if model else float(otherwise == "block")
        return pd.Series(out)

    score = F.when(F.col("rule").isNull(), scored(F.col("u"), F.col("rule")))
    return ruled.withColumn("block_score", score).select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("said", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round("block_score", 6).alias("block_score"))
