"""Merkle manifest of a table: a leaf for every row, a tree for every group, one root over the groups.

A leaf is the SHA-256 of a row's fields, each ``-`` if null and else its UTF-8 byte count, ``:`` and its
value; a node is the SHA-256 of up to ``ARITY`` consecutive digests written as hex. Leaves of a group
ascend by the ordering column; groups ascend by name, null first.

Rows read their text once, when leaves are made; afterwards only digests move. A global sort by ranges gives
every leaf its place in its group, however large the group is. ``ARITY ** BLOCK_LEVELS`` consecutive nodes
are a superblock. Going up, each superblock is reduced to its top, round by round, until every group has one
node. Coming down, the nodes of a superblock are cogrouped with the one row of outer nodes that it needs (the
siblings on the way from its top to the root); that call finishes the local reduction, joins the inner
siblings to the outer ones and folds every presented leaf up to a root. No task holds more than a superblock.

Cases: a null in any field is a value of its own (``-``), also as group, whose rows form the first tree, and
as ordering value, which sorts first and is never tampered with in the query. Rows with equal ordering
values are ordered by leaf digest; equal rows are leaves of their own and interchangeable. An empty text is
``0:``. A group of one row has its leaf as root, and so has a table of one row. An empty table gives no rows.
Only the named fields are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.session import staged

ARITY = 3
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64

_TOPS = "tree string, pos long, size long, digest string"
_OUTER = "tree string, pos long, proof string, path string, subroot string, root string"
_ROWS = "id long, leaf string, subroot string, root string, proof string, path string, folded_root string"


def leaf_digest(fields: Sequence[str] = FIELDS, changed: Mapping[str, Column] | None = None) -> Column:
    """The leaf of a row, with some fields replaced by other columns."""

    def encoded(column: Column) -> Column:
        value = column.cast("string")
        told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        return F.when(value.isNull(), F.lit("-")).otherwise(told)

    changed = changed or {}
    return F.sha2(F.concat(*[encoded(changed.get(name, F.col(name))) for name in fields]), 256)


def node_digest(digests: str) -> str:
    """The node over a run of digests, joined as hex text."""
    return hashlib.sha256(digests.encode()).hexdigest()


def fold(leaf: str, proof: str, path: str) -> str:
    """The root that a leaf leads to with its siblings; ``path`` has a place and a run length for each level."""
    own, at = leaf, 0
    for place, length in zip(path[::2], path[1::2], strict=True):
        mine, end = at + _HEX * int(place), at + _HEX * (int(length) - 1)
        own = node_digest(proof[at:mine] + own + proof[mine:end])
        at = end
    return own


def _levels(size: int) -> int:
    """Levels from a superblock of a tree of ``size`` nodes up to its top."""
    levels = 0
    while size > 1 and levels < BLOCK_LEVELS:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _tiers(digests: list[str], levels: int) -> list[list[str]]:
    tiers = [digests]
    for _ in range(levels):
        low = tiers[-1]
        tiers.append([node_digest("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return tiers


def _inner_proofs(digests: list[str], levels: int, proof: str, path: str) -> tuple[list[str], list[str]]:
    """Siblings and path of every node of a superblock, given those of its top."""
    proofs, paths = [proof], [path]
    for tier in reversed(_tiers(digests, levels)[:-1]):
        runs = [tier[i : i + ARITY] for i in range(0, len(tier), ARITY)]
        below = [
            ("".join(run[:place] + run[place + 1 :]) + proofs[up], f"{place}{len(run)}{paths[up]}")
            for up, run in enumerate(runs)
            for place in range(len(run))
        ]
        proofs, paths = (list(x) for x in zip(*below, strict=True))
    return proofs, paths


def _top(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    tree, block, size = frame[["tree", "block", "size"]].iloc[0]
    top = _tiers(frame["digest"].tolist(), _levels(size))[-1]
    return pd.DataFrame({"tree": tree, "pos": block, "size": -(-size // ARITY**BLOCK_LEVELS), "digest": top})


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a superblock in order, with their whole proofs."""
    nodes, above = nodes.sort_values("pos"), outer.iloc[0]
    proofs, paths = _inner_proofs(nodes["digest"].tolist(), _levels(nodes["size"].iloc[0]), above["proof"], above["path"])
    return nodes.assign(proof=proofs, path=paths, subroot=above["subroot"], root=above["root"])


def _inner(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    return _joined(nodes, outer)[["tree", "pos", "proof", "path", "subroot", "root"]]


def _folded(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = _joined(leaves, outer)
    ways = zip(rows["presented"], rows["proof"], rows["path"], strict=True)
    rows = rows.assign(leaf=rows["digest"], folded_root=[fold(*way) for way in ways])
    return rows[["id", "leaf", "subroot", "root", "proof", "path", "folded_root"]]


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``pos`` (from 0) within ``tree`` along ``order``, ``size`` (rows of the tree) and ``block``.

    One sort by ranges; a tree may lie in many partitions, and one row for each of them tells how many
    of its rows come before.
    """
    sort = ["tree", *order]
    ranged = nodes.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1))
    parts = ordered.groupBy("tree", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")
    )
    found = ordered.join(staged(shifts, "merkle-parts"), ["tree", "part"])
    found = found.withColumn("pos", F.col("nth") + F.col("shift"))
    return _blocks(found.drop("at", "part", "nth", "shift"))


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**BLOCK_LEVELS))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tops of their superblocks, again and again, until every tree has a single node."""
    rounds = [nodes]
    while True:
        below = rounds[-1] if len(rounds) == 1 else rounds[-1].where("size > 1")
        tops = below.select("tree", "block", "pos", "size", "digest").groupBy("tree", "block").applyInPandas(_top, _TOPS)
        rounds.append(_blocks(staged(tops, "merkle-tops")))
        if (rounds[-1].agg(F.max("size")).first()[0] or 1) == 1:
            return rounds


def _outer_nodes(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """What each superblock of ``rounds[0]`` needs from outside, given ``(tree, proof, path, ...)`` of the roots."""
    outer = None
    for at in range(len(rounds) - 1, 0, -1):
        done = rounds[at].where("size = 1").select("tree", "pos").join(ends, "tree")
        if outer is not None:
            nodes = rounds[at].where("size > 1").groupBy("tree", "block")
            below = nodes.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(_inner, _OUTER)
            done = done.select(*below.columns).unionByName(below)
        outer = staged(done, "merkle-outer")
    return outer


def merkle_manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    presented: Column | None = None,
) -> DataFrame:
    """``(<order>, leaf, subroot, root, proof, path, folded_root, verified)`` for every row.

    ``presented`` is the leaf digest that a holder of the row shows (null: the row's own); it is folded
    with the row's siblings, and ``verified`` tells whether that gives the root. ``proof`` joins the hex
    digests of all siblings from the leaf up, left to right; ``path`` has two digits for each level, the
    place within the run and the run's length. ``fold(leaf, proof, path)`` repeats the check anywhere.
    """
    own = leaf_digest(fields)
    shown = own if presented is None else F.coalesce(presented, own)
    # the empty name sorts before all others
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    made = docs.select(tree.alias("tree"), F.col(order).cast("long").alias("id"), own.alias("digest"), shown.alias("presented"))
    # equal rows are told apart, so that a range border may fall between them
    leaves = _placed(staged(made.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves"), "id", "digest", "row")
    rounds = _rounds(leaves)
    roots = reduce(DataFrame.unionByName, [r.where("size = 1").select("tree", "digest") for r in rounds[1:]])
    groups = _rounds(_placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    root = groups[-1].select(
        "tree", F.lit("").alias("proof"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    named = groups[0].select("tree", "block", "pos", "size", "digest", "name")
    outer = _outer_nodes(groups, root).withColumnRenamed("pos", "block").groupBy("tree", "block")
    ends = "tree string, proof string, path string, subroot string, root string"
    group_ends = staged(named.groupBy("tree", "block").cogroup(outer).applyInPandas(_group_ends, ends), "merkle-groups")
    above = _outer_nodes(rounds, group_ends).withColumnRenamed("pos", "block").groupBy("tree", "block")
    rows = leaves.select("tree", "block", "pos", "size", "digest", "id", "presented").groupBy("tree", "block")
    folded = rows.cogroup(above).applyInPandas(_folded, _ROWS)
    return folded.withColumnRenamed("id", order).withColumn("verified", F.col("folded_root") == F.col("root"))


def _group_ends(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = _joined(nodes, outer)
    return pd.DataFrame(
        {"tree": rows["name"], "proof": rows["proof"], "path": rows["path"], "subroot": rows["digest"], "root": rows["root"]}
    )
