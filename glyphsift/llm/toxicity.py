"""Toxicity by a classifier chain of linear models over the words of a text and their beginnings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, joined_buffers, mixed, word_hashes, word_spans

#: Folds for out-of-fold predictions.
FOLDS = 5
#: Bytes of the word beginnings that are features beside whole words: stems of compounds.
PREFIXES = (4, 5)


class Linear:
    """Logistic regression on whether chosen words occur, and on the probabilities of earlier categories."""

    def __init__(self, words: int = 256, penalty: float = 1.0, least: int = 5):
        self.most, self.penalty, self.least = words, penalty, least

    def fit(self, rows: np.ndarray, words: np.ndarray, n: int, y: np.ndarray, earlier: np.ndarray) -> Linear:
        """rows, words: one pair for each different word of a text; earlier: a column for each earlier category."""
        self.words = self._chosen(rows, words, y)
        x = self._design(rows, words, n, earlier)
        w = np.zeros(x.shape[1])
        flat = np.full(len(w), self.penalty)
        flat[-1] = 1e-6
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(flat), x.T @ (p - y) + flat * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def score(self, rows: np.ndarray, words: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip(self._design(rows, words, n, earlier) @ self.weights, -30, 30)

    def _chosen(self, rows, words, y) -> np.ndarray:
        """The features that tell most about the class, by their log-likelihood ratio."""
        distinct, where = np.unique(words, return_inverse=True)
        total = np.bincount(where, minlength=len(distinct)).astype(float)
        of = np.bincount(where, y[rows], len(distinct))
        n, n1 = len(y), float(y.sum())

        def part(seen, expected):
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

        g = part(of, total * n1 / n) + part(total - of, total * (n - n1) / n) + part(n1 - of, (n - total) * n1 / n) + part(n - n1 - total + of, (n - total) * (n - n1) / n)
        g[total < self.least] = 0
        best = np.lexsort((distinct, -g))[: self.most]
        return np.sort(distinct[best[g[best] > 0]])

    def _design(self, rows, words, n, earlier) -> np.ndarray:
        x = np.zeros((n, len(self.words) + earlier.shape[1] + 1))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            x[rows[hit], at[hit]] = 1
        x[:, len(self.words) : -1] = earlier
        x[:, -1] = 1
        return x


class Chain:
    """One linear model for each category in order, each fed the probabilities of those before it."""

    def fit(self, rows: np.ndarray, words: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        """y: a column for each category. A later model learns from earlier categories' out-of-fold probabilities."""
        n = len(y)
        earlier, self.models, self.cuts = np.zeros((n, 0)), [], []
        for c in range(y.shape[1]):
            out = np.zeros(n)
            for f in range(FOLDS):
                test = fold == f
                if not test.any() or test.all():
                    continue
                new = np.cumsum(~test) - 1
                ours = ~test[rows]
                model = Linear().fit(new[rows[ours]], words[ours], int((~test).sum()), y[~test, c], earlier[~test])
                new = np.cumsum(test) - 1
                out[test] = model.score(new[rows[~ours]], words[~ours], int(test.sum()), earlier[test])
            self.models.append(Linear().fit(rows, words, n, y[:, c], earlier))
            self.cuts.append(best_cut(out, y[:, c]))
            earlier = np.column_stack([earlier, probability(out)])
        self.held_out = earlier
        return self

    def score(self, rows, words, n) -> np.ndarray:
        """Log-odds of each category."""
        earlier, out = np.zeros((n, 0)), np.zeros((n, 0))
        for model in self.models:
            odds = model.score(rows, words, n, earlier)
            out, earlier = np.column_stack([out, odds]), np.column_stack([earlier, probability(odds)])
        return out


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which flagging gives the best F1, halfway to the next score below; without positives, none."""
    if not y.any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(score[order][1:] < score[order][:-1], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    below = score[order][i + 1] if i + 1 < len(y) else score[order][i] - 1
    return float((score[order][i] + below) / 2)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of each text, and of the first 4 and 5 bytes of longer words."""
    raw, at = joined_buffers(column)
    raw = LOWER[raw]
    start, end, first = word_spans(raw, at, LETTERS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    rows, hashes = [row], [word_hashes(raw, start, end)]
    for n in PREFIXES:
        long_ = np.flatnonzero(end - start > n)
        rows.append(row[long_])
        hashes.append(mixed(word_hashes(raw, start[long_], start[long_] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def distinct_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, in order of rows."""
    row, hashes = features(column)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", most_rows: int = 8_000) -> Chain | None:
    """A chain over ``categories`` (name -> 0/1 expression on ``labels``, in order) from labelled texts.

    ``most_rows`` bounds the labelled keys that the driver gathers, those with the least hash, and twice as many
    their texts, as a key may have several rows: those with the least keys. A row with a null category is not
    used; of several labels for a key the largest holds, of several texts each. None if no labelled text is found.
    """
    names = list(categories)
    marks = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[e.cast("int").alias(f"y{i}") for i, e in enumerate(categories.values())]).groupBy("k").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).dropna()
    hashed = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = min(1.0, 1.2 * most_rows / max(1, labels.count()))
    sample = marks.where(hashed <= F.lit(int(share * (1 << 30)))).orderBy(hashed, "k").limit(most_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")  # at most most_rows rows of integers

    def f(batches):
        for batch in batches:
            row, words = distinct_features(batch.column(1))
            at = np.searchsorted(row, np.arange(len(batch) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], ["k", "w", *[f"y{i}" for i in range(len(names))]])

    kinds = ", ".join(f"y{i} int" for i in range(len(names)))
    got = rows.select("k", "t", *[f"y{i}" for i in range(len(names))]).mapInArrow(f, f"k long, w array<long>, {kinds}").orderBy("k", F.xxhash64("w")).limit(2 * most_rows).toArrow().combine_chunks()
    if not len(got):
        return None
    y = np.column_stack([got.column(f"y{i}").to_numpy() for i in range(len(names))]).astype(float)
    lists = got.column("w").combine_chunks()
    length = np.array([len(x) for x in lists])
    words = lists.flatten().to_numpy().view(np.uint64)
    keys = got.column("k").to_numpy()
    fold = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)  # equal keys share a fold
    return Chain().fit(np.repeat(np.arange(len(length)), length), words, y, fold)


def score(docs: DataFrame, chain: Chain | None, names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, probability p_<name> of each category, and toxic: whether the last one passes its cut.

    The cut gives the best F1 on out-of-fold predictions. Null and empty texts have no words and are scored
    by the intercepts; without a chain probabilities are null and nothing is toxic. Repeated rows score
    alike, and a score at the cut counts as toxic; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    if chain is None:
        return rows.select(F.col("k").alias(key), *[F.lit(None).cast("double").alias(f"p_{n}") for n in names], F.lit(False).alias("toxic"))
    chain.held_out = None

    def f(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                odds = chain.score(*features(part.column(1)), len(part))
                p = [pa.array(np.round(probability(odds[:, i]), 6)) for i in range(odds.shape[1])]
                yield pa.RecordBatch.from_arrays([part.column(0), *p, pa.array(odds[:, -1] >= chain.cuts[-1])], [key, *[f"p_{n}" for n in names], "toxic"])

    return rows.mapInArrow(f, f"{key} long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean")
