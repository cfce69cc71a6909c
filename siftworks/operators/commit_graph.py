"""The order of a walk over commits, from parents and heads.

A commit's place follows from two labels that travel from children to parents: its depth, the longest way from a head,
and its floor, the least time among itself and all commits above it. Sorted by floor, newest first, and then by
depth, every child comes before its parents, and commits come by time as far as that allows: where no parent is newer
than its child the floor is the commit's own time.

Following a history commit by commit would take as many rounds as the history is long. Commits of a repository are cut
into blocks by time instead; a task carries labels through a whole block at once, and only labels that leave a block go
on to the next round, in which only blocks that got any take part. A history of a million commits takes a
few rounds, and no task holds more than a block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.operators.ranking import ranked_by_range
from siftworks.session import staged

BLOCK = 1 << 18
_NEVER = 1 << 62
_LABELS = "repo string, block long, hash string, depth long, floor long"


def _carried(nodes: list[dict], inbox: list[dict], block: int) -> tuple[dict[str, tuple[int, int]], list[tuple]]:
    """Labels of the block's reachable commits, and those that go to parents in other blocks."""
    by_hash = {n["hash"]: n for n in nodes}
    waiting = dict.fromkeys(by_hash, 0)
    for node in nodes:
        for parent, at in zip(node["parents"], node["blocks"], strict=True):
            if at == block:
                waiting[parent] += 1
    labels: dict[str, tuple[int, int]] = {}

    def reach(name: str, depth: int, floor: int) -> None:
        known = labels.get(name)
        labels[name] = (max(depth, known[0]), min(floor, known[1])) if known else (depth, floor)

    for row in inbox:
        if row["hash"] in by_hash:
            reach(row["hash"], row["depth"], row["floor"])
    ready, leaving = [name for name, n in waiting.items() if not n], []
    while ready:
        name = ready.pop()
        node = by_hash[name]
        if name in labels:
            depth, floor = labels[name]
            labels[name] = depth, floor = depth, min(floor, node["time"])
        for parent, at in zip(node["parents"], node["blocks"], strict=True):
            if at != block:
                if name in labels:
                    leaving.append((at, parent, depth + 1, floor))
                continue
            if name in labels:
                reach(parent, depth + 1, floor)
            waiting[parent] -= 1
            if not waiting[parent]:
                ready.append(parent)
    if any(waiting.values()):
        raise ValueError("the parents of commits form a cycle")
    return labels, leaving


def _run(leaving: bool):
    """A cogrouped step: labels of a block's commits, or those that leave it."""

    def run(nodes: pa.Table, inbox: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        names = [field.split()[0] for field in _LABELS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        made: list[tuple] = []
        if rows:
            repo, block = rows[0]["repo"], rows[0]["block"]
            labels, gone = _carried(rows, inbox.to_pylist(), block)
            if leaving:
                made = [(repo, *row) for row in gone]
            else:
                made = [(repo, block, name, depth, floor) for name, (depth, floor) in labels.items()]
        columns = zip(*made, strict=True) if made else [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _merged(labels: DataFrame) -> DataFrame:
    return labels.groupBy("repo", "block", "hash").agg(F.max("depth").alias("depth"), F.min("floor").alias("floor"))


def _blocks(commits: DataFrame, block: int) -> DataFrame:
    """``(repo, block, hash, time, parents, blocks)``: each commit with the blocks of those parents that are there."""
    # blocks by time: nearly all parents lie in the block of their child or the next one
    nodes = commits.select("repo", "hash", F.coalesce(F.col("time").cast("long"), F.lit(-_NEVER)).alias("time"), "parents")
    ranked = ranked_by_range(nodes.dropDuplicates(["repo", "hash"]), ["repo"], [F.desc("time"), F.col("hash")])
    placed = staged(ranked.withColumn("block", F.floor((F.col("rank") - 1) / block)).drop("rank"), "commits")
    edges = placed.select("repo", F.col("hash").alias("child"), F.explode(F.array_distinct("parents")).alias("parent"))
    found = edges.join(placed.select("repo", F.col("hash").alias("parent"), "block"), ["repo", "parent"])
    grouped = found.groupBy("repo", F.col("child").alias("hash")).agg(F.collect_list(F.struct("parent", "block")).alias("_up"))
    none = F.array().cast("array<struct<parent: string, block: long>>")
    joined = placed.drop("parents").join(grouped, ["repo", "hash"], "left").withColumn("_up", F.coalesce("_up", none))
    return joined.select("repo", "block", "hash", "time", F.col("_up.parent").alias("parents"), F.col("_up.block").alias("blocks"))


def walk_from_heads(commits: DataFrame, heads: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``commits(repo, hash, parents, time, ...)`` that a head reaches, with ``commit_pos``, from 1, in walk order.

    ``heads(repo, hash)`` holds all branches of a repository, or where it points to without any; heads and
    parents that are not among the commits are passed over, as in a shallow clone. Children come before parents,
    newest first; of equal ones the smaller hash. ``time`` is in whole units of any kind, null is the oldest. Of
    repeated hashes one counts. Parents that form a cycle are an error.
    """
    nodes = staged(_blocks(commits, block), "blocks")
    places = nodes.select("repo", "hash", "block")
    started = heads.select("repo", "hash").distinct().join(places, ["repo", "hash"])
    inbox = staged(started.select("repo", "block", "hash", F.lit(0).cast("long").alias("depth"), F.lit(_NEVER).alias("floor")), "heads")
    fresh, longest = inbox, nodes.count()
    while not fresh.isEmpty():
        active = fresh.select("repo", "block").distinct()
        groups = [df.join(active, ["repo", "block"], "left_semi").groupBy("repo", "block") for df in (nodes, inbox)]
        sent = _merged(groups[0].cogroup(groups[1]).applyInArrow(_run(True), _LABELS))
        known = inbox.select("repo", "block", "hash", F.col("depth").alias("_depth"), F.col("floor").alias("_floor"))
        better = F.col("_depth").isNull() | (F.col("depth") > F.col("_depth")) | (F.col("floor") < F.col("_floor"))
        fresh = staged(sent.join(known, ["repo", "block", "hash"], "left").where(better).select(*inbox.columns), "labels")
        if (fresh.agg(F.max("depth")).first()[0] or 0) > longest:
            raise ValueError("the parents of commits form a cycle")
        inbox = staged(_merged(inbox.unionByName(fresh)), "inbox")
    reached = nodes.groupBy("repo", "block").cogroup(inbox.groupBy("repo", "block")).applyInArrow(_run(False), _LABELS)
    known = nodes.select("repo", "hash", "time").join(reached.select("repo", "hash", "depth", "floor"), ["repo", "hash"])
    order = [F.desc("floor"), F.col("depth"), F.desc("time"), F.col("hash")]
    ranked = ranked_by_range(known, ["repo"], order, "commit_pos").select("repo", "hash", "commit_pos")
    names = [c for c in commits.columns if c != "commit_pos"]
    return commits.select(*names).dropDuplicates(["repo", "hash"]).join(ranked, ["repo", "hash"])
