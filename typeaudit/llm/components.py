"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeaudit.session import discard, materialize


def smallest_reachable(links: DataFrame, label: str = "stars") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links(a, b)``; component is the smallest node reachable.

    Each round links every node to the smallest of its neighbours, first its larger and then its
    smaller ones, and writes the links to the shared folder, where the last ones stay; their number never grows and rounds are
    logarithmic in it. Minimums are partial aggregates, so a node with a third of all links sends one
    row per task. Loops and repeated links are allowed; an empty table gives an empty one.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    edges = materialize(links.where("a <> b").select(up.alias("a"), down.alias("b")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(
            F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        )
        older, edges = edges, materialize(small.where("a <> b").distinct(), label)
        discard(older)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
