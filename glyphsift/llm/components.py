"""Connected components of links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node that it reaches.

    ``rows``: how many links there are at most; without it they are counted.

    Each round every node takes the least root among its neighbours', and then its root's root, so paths
    shorten by more than half. Rounds are kept in the shared folder; nothing is collected but a count.
    """
    most = 2 * (links.count() if rows is None else rows)
    edges = saved(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), most)
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), most)
    for _ in range(most_rounds):
        near = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        taken = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = labels.select(F.col("node").alias("up"), F.col("root").alias("upper"))
        new = saved(taken.join(above.hint("merge"), taken["root"] == above["up"], "left").select("node", "was", F.least("root", F.coalesce("upper", "root")).alias("root")), most)
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links: only the links between different roots are followed."""
    at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")).hint("merge")
    ends = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rows = links.count()
    moved = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), rows=rows)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots.select("node").hint("merge"), "node", "left_anti").select("node", "root")
    return saved(old.unionByName(new), roots.count() + 2 * rows)
