"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

A leaf is any hex digest of a row. The rows of a group stand in order; while several nodes remain, each run of ``fanout``
consecutive ones (the last may be shorter) is hashed, as hex text, to a node of the next level. The roots of the groups, in the order of the groups,
are the leaves of the last tree.

Levels are concatenated strings: an aligned block of ``fanout ** levels`` nodes keeps each of its levels as one string of hex digests.
A parent is the hash of a substring of fixed width; the siblings of a node are the two substrings beside it in its run. What is left of
a block is one node, so blocks are the nodes of the next round, which does the same over a 512th of the rows.

Scale: positions come from sorted ranges (``ranking.py``), blocks are equal in size whatever the groups are, and texts are read once,
for the leaves. A block row holds at most ``fanout ** levels`` digests, a path a few hundred bytes for each level. A round costs one shuffle of
digests; three rounds reach 134 million rows a group. Only the number of the rounds comes to the driver. Paths are handed down by a join on
(group, block), so a group that holds a third of all rows is many keys. Each round is written to the shared folder.

Cases: null fields are part of a leaf like others (``field``). Rows equal in group and order stand by their digest; rows equal in that too are
interchangeable. A null group is a group of its own, and comes first. A group of one row is its leaf. An empty table has no root and gives
no row. Kept columns stay in ``row``, so their names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.llm.ranking import met, ranked
from typeaudit.session import materialize

#: Characters of a digest.
HEX = 64


class Settings(NamedTuple):
    fanout: int = 8
    #: Levels that a block holds above its nodes.
    levels: int = 3

    @property
    def width(self) -> int:
        return self.fanout**self.levels


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that no other sequence of fields can be mistaken for: its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _node(level: Column, at: Column, count: Column | int = 1) -> Column:
    """``count`` digests of a level's string, from the one at ``at`` on."""
    return F.substr(level, (at * HEX + 1).cast("int"), (F.lit(count) * HEX).cast("int"))


def _parents(level: Column, fanout: int) -> Column:
    last = F.ceil(F.length(level) / (HEX * fanout)) - 1
    runs = F.sequence(F.lit(0).cast("long"), last)
    return F.array_join(F.transform(runs, lambda at: F.sha2(_node(level, at * fanout, fanout), 256)), "")


def _height(total: Column, fanout: int) -> Column:
    """Levels above ``total`` nodes."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < total))


def _blocks(nodes: DataFrame, settings: Settings, kept: list[str]) -> DataFrame:
    """``nodes(grp, at, total, digest, ..)`` as block rows: nodes in order, a string for each level, and the node that is left."""
    row = F.struct("at", "digest", *kept)
    found = nodes.groupBy("grp", F.floor(F.col("at") / settings.width).alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("nodes"), F.max("total").alias("total")
    )
    found = found.withColumn("climbs", F.least(F.lit(settings.levels), _height(F.col("total"), settings.fanout)))
    found = found.withColumn("level_0", F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
    top = F.col("level_0")
    for k in range(1, settings.levels + 1):
        found = found.withColumn(f"level_{k}", F.when(F.col("climbs") >= k, _parents(F.col(f"level_{k - 1}"), settings.fanout)))
        top = F.coalesce(F.col(f"level_{k}"), top)
    return found.withColumn("top", top)


def _segments(at: Column, settings: Settings) -> Column:
    """For each level that a block climbs, the siblings left and right of the node above position ``at``."""
    found, fanout = [], settings.fanout
    for k in range(settings.levels):
        level, node = F.col(f"level_{k}"), F.floor(at / fanout**k)
        begin = F.floor(node / fanout) * fanout
        sides = F.struct(
            _node(level, begin, node - begin).alias("left"),
            _node(level, node + 1, begin + fanout - node - 1).alias("right"),
        )
        found.append(F.when(F.col("climbs") > k, sides))
    return F.filter(F.array(*found), lambda sides: sides.isNotNull())


class Tree(NamedTuple):
    """Block tables from the leaves up, and ``roots(grp, top)``."""

    rounds: list[DataFrame]
    roots: DataFrame
    settings: Settings


def grow(nodes: DataFrame, settings: Settings, kept: list[str]) -> Tree:
    """``nodes(grp, at, total, digest, ..)`` to trees, one for each ``grp``."""
    rounds = [materialize(_blocks(nodes, settings, kept), "merkle")]
    most = rounds[0].agg(F.max("total")).first()[0] or 0
    while most > settings.width:
        most = -(-most // settings.width)
        total = F.ceil(F.col("total") / settings.width).alias("total")
        above = rounds[-1].select("grp", F.col("block").alias("at"), total, F.col("top").alias("digest"))
        rounds.append(materialize(_blocks(above, settings, []), "merkle"))
    return Tree(rounds, rounds[-1].select("grp", "top"), settings)


def descend(tree: Tree, ends: DataFrame, carried: list[str]) -> DataFrame:
    """Each leaf's node and path. ``ends(grp, path, ..)`` has what continues beyond each root; ``carried`` columns go along."""
    paths = ends.select("grp", F.lit(0).cast("long").alias("at"), "path", *carried)
    for blocks in reversed(tree.rounds):
        above = paths.withColumnRenamed("at", "block")
        nodes = F.posexplode("nodes").alias("inner", "node")
        each = met(blocks, above, ["grp", "block"]).select("grp", "climbs", "path", *carried, *[f"level_{k}" for k in range(tree.settings.levels)], nodes)
        path = F.concat(_segments(F.col("inner"), tree.settings), "path")
        paths = each.select("grp", "node", F.col("node.at").alias("at"), path.alias("path"), *carried)
    return paths


class Manifest(NamedTuple):
    """``subroots(grp, subroot, root)``, and ``proofs`` of all rows."""

    subroots: DataFrame
    proofs: DataFrame


def manifest(
    rows: DataFrame, leaf: Column, group: Column, order: Column, kept: dict[str, Column], settings: Settings = Settings()
) -> Manifest:
    """The trees over ``rows``, one for each ``group`` in the order of ``order``.

    ``proofs``: ``row`` (struct of the kept columns), grp, leaf, subroot, root, path (siblings left and right, from the
    leaf up to the root).
    """
    row = F.struct(*[value.alias(name) for name, value in kept.items()]).alias("row")
    leaves = materialize(rows.select(group.alias("grp"), order.alias("key"), leaf.alias("digest"), row), "merkle-leaves")
    tree = grow(ranked(leaves, "grp", ["key", "digest"], "merkle-order"), settings, ["row"])
    subroots = tree.roots.select(F.lit(0).alias("whole"), F.struct("grp").alias("owner"), F.col("top").alias("digest"))
    over = grow(
        ranked(subroots, "whole", ["owner"], "merkle-groups").withColumnRenamed("whole", "grp"), settings, ["owner"]
    )
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    ends = over.roots.select("grp", F.col("top").alias("root"), no_path.alias("path"))
    of_groups = descend(over, ends, ["root"]).select(
        F.col("node.owner.grp").alias("grp"), F.col("node.digest").alias("subroot"), "root", "path"
    )
    of_groups = materialize(of_groups, "merkle-subroots")
    proofs = descend(tree, of_groups, ["subroot", "root"])
    return Manifest(
        of_groups.select("grp", "subroot", "root"),
        proofs.select(F.col("node.row").alias("row"), "grp", F.col("node.digest").alias("leaf"), "subroot", "root", "path"),
    )


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda sides: F.concat(sides["left"], sides["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, sides: digest(sides["left"], node, sides["right"]))
