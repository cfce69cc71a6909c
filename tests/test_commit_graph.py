from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.operators import history
from siftworks.operators.commit_graph import walk_from_heads
from siftworks.operators.ranking import ranked_by_range

COMMITS = "repo string, hash string, parents array<string>, time long, summary string"
HEADS = "repo string, hash string"


def walked(frame, commits, heads, **options):
    rows = walk_from_heads(frame([(*c, "s") for c in commits], COMMITS).repartition(3), frame(heads, HEADS), **options).collect()
    return [(r.repo, r.hash) for r in sorted(rows, key=lambda r: (r.repo, r.commit_pos))]


def brute_force(commits, heads):
    """Labels by repeated relaxation over all edges, then sorted."""
    by_name = {(c[0], c[1]): c for c in commits}
    depth = {h: 0 for h in heads if h in by_name}
    floor = {h: by_name[h][3] for h in depth}
    changed = True
    while changed:
        changed = False
        for name in list(depth):
            for parent in by_name[name][2]:
                up = (name[0], parent)
                if up in by_name:
                    d, f = max(depth.get(up, 0), depth[name] + 1), min(floor.get(up, by_name[up][3]), floor[name], by_name[up][3])
                    if up not in depth or (d, f) != (depth[up], floor[up]):
                        depth[up], floor[up], changed = d, f, True
    return sorted(depth, key=lambda n: (n[0], -floor[n], depth[n], -by_name[n][3], n[1]))


def priority_queue(commits, heads):
    """Among commits whose children are all out, the newest is next."""
    by_name = {(c[0], c[1]): c for c in commits}
    reach, todo = set(), [h for h in heads if h in by_name]
    while todo:
        name = todo.pop()
        if name in by_name and name not in reach:
            reach.add(name)
            todo += [(name[0], p) for p in by_name[name][2]]
    result, left = [], set(reach)
    while left:
        ready = [n for n in left if not any((n[0], n[1]) in {(c[0], p) for p in by_name[c][2]} for c in left)]
        result.append(min(ready, key=lambda n: (n[0], -by_name[n][3], n[1])))
        left.remove(result[-1])
    return result


def history_of(seed, n, skew):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        older = [f"c{j:03d}" for j in range(max(0, i - 9), i)]
        parents = rng.sample(older, min(len(older), rng.choice((1, 1, 1, 2, 3)))) if i % 40 else []
        if i % 13 == 5:
            parents.append("unknown")
        rows.append(("a", f"c{i:03d}", parents, i * 10 + (rng.randrange(-60, 60) if skew else 0)))
    return rows


@pytest.mark.parametrize("block", [9, 1000])
def test_order_with_merges_and_skewed_clocks(frame, block):
    rows = history_of(1, 60, True)
    rows += [("b", r[1], r[2], r[3]) for r in history_of(2, 25, True)]
    heads = [("a", "c059"), ("a", "c041"), ("b", "c024"), ("b", "missing"), ("c", "c001")]
    found = walked(frame, rows, heads, block=block)
    assert found == brute_force(rows, heads)
    place = {name: i for i, name in enumerate(found)}
    for repo, name, parents, _ in rows:
        for p in parents:
            if (repo, name) in place and (repo, p) in place:
                assert place[repo, name] < place[repo, p]
    assert len(found) < len(rows)  # not every commit is reachable


def test_right_clocks_give_the_order_of_a_priority_queue(frame):
    rows = history_of(3, 50, False)
    heads = [("a", "c049"), ("a", "c030")]
    assert walked(frame, rows, heads, block=8) == priority_queue(rows, heads)


def test_a_long_chain_takes_few_rounds(frame, monkeypatch):
    from siftworks.operators import commit_graph

    n, rounds = 400, []
    real = commit_graph.staged
    monkeypatch.setattr(commit_graph, "staged", lambda df, purpose: rounds.append(purpose) or real(df, purpose))
    rows = [("a", f"c{i:03d}", [f"c{i - 1:03d}"] if i else [], i) for i in range(n)]
    assert walked(frame, rows, [("a", f"c{n - 1:03d}")], block=100) == [("a", f"c{i:03d}") for i in reversed(range(n))]
    assert rounds.count("labels") == 4


def test_odd_inputs(frame):
    """Equal times, no time, repeated rows, no heads, no commits, a cycle within and across blocks."""
    rows = [("a", "x", ["y", "y"], 5), ("a", "x", ["y"], 5), ("a", "y", None, None), ("a", "w", ["y"], 5)]
    assert walked(frame, rows, [("a", "x"), ("a", "w"), ("a", "w")]) == [("a", "w"), ("a", "x"), ("a", "y")]
    assert walked(frame, rows, []) == [] and walked(frame, [], [("a", "x")]) == []
    for block in (1, 10):
        with pytest.raises(Exception, match="cycle"):
            walked(frame, [("a", "x", ["y"], 1), ("a", "y", ["x"], 2)], [("a", "x")], block=block)


def test_walk_feeds_the_history(frame):
    rows = [("a", f"c{i:03d}", [f"c{i - 1:03d}"] if i else [], i, "s") for i in range(6)]
    commits = walk_from_heads(frame(rows, COMMITS), frame([("a", "c004")], HEADS)).withColumn("parent_count", F.size("parents"))
    lines = frame([("a", f"c{i:03d}", "f", "+", 1, 1, b"listen 10.0.0.1\n") for i in range(6)], "repo string, hash string, file string, origin string, new_lineno int, seq long, content binary")
    assert history.history_lines(commits, lines).count() == 5


def test_ranked_by_range(frame):
    rows = [(random.Random(i).choice(("a", "b", None)), i * 37 % 101) for i in range(101)]
    found = ranked_by_range(frame(rows, "k string, v long").repartition(5), ["k"], [F.desc("v")]).collect()
    for key in ("a", "b", None):
        values = sorted((v for k, v in rows if k == key), reverse=True)
        assert [r.v for r in sorted((r for r in found if r.k == key), key=lambda r: r["rank"])] == values
        assert sorted(r["rank"] for r in found if r.k == key) == list(range(1, len(values) + 1))
