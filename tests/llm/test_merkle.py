from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from cases import DOCS, docs, got
from pyspark.sql import functions as F

from siftworks.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, pos string, root string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(frame, rows):
    return frame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climbed(digests, place):
    """The root over ``digests`` and the siblings of one of them on the way up."""
    siblings = []
    while len(digests) > 1:
        run = place // 3 * 3
        siblings += [d for i, d in enumerate(digests[run : run + 3], run) if i != place]
        digests = [sha("".join(digests[i : i + 3])) for i in range(0, len(digests), 3)]
        place //= 3
    return digests[0], siblings


def brute_force(rows):
    """``(doc_id, leaf, subroot, root, proof)`` of every row, one tree after the other."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in names}
    leaves = {s: [leaf_of(r) for r in ordered[s]] for s in names}
    subroots = [climbed(leaves[s], 0)[0] for s in names]
    result = []
    for k, s in enumerate(names):
        root, outer = climbed(subroots, k)
        for i, row in enumerate(ordered[s]):
            subroot, inner = climbed(leaves[s], i)
            result.append((row[0], leaves[s][i], subroot, root, "".join(inner + outer)))
    return sorted(result, key=lambda r: tuple((x is None, str(x)) for x in r))


AWKWARD = [(d, ("b", None, "é", "", "b")[i % 5], None if i % 3 else "en", None if i % 4 else 7, t) for i, (d, t) in enumerate(DOCS)]


@pytest.mark.parametrize(
    "rows",
    [
        AWKWARD,
        AWKWARD[:1],
        [(i, f"s{i}", "en", 1, "t") for i in range(11)],
        [(None, None, None, None, None)] * 7,
        [(i * 7 % 800, "hot" if i % 8 else f"s{i % 5}", "en", i, f"line\n{i}") for i in range(2600)],
    ],
    ids=["awkward", "one", "one row a group", "equal rows", "several rounds of superblocks"],
)
def test_against_brute_force(frame, rows):
    found = M.merkle_manifest(table(frame, rows).repartition(3)).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in found)
    assert all(M.fold(r["leaf"], r["proof"], r["path"]) == r["root"] for r in found)
    ours = sorted(
        ((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )
    assert ours == brute_force(rows)


def test_a_changed_row_does_not_fold_to_the_root(frame):
    rows = [(i, f"s{i % 2}", "en", 1, f"a\nb {i}" if i % 3 else f"plain {i}") for i in range(40)]
    cut = M.leaf_digest(changed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    shown = F.when(F.col("doc_id") < 20, cut)
    found = {r["doc_id"]: r for r in M.merkle_manifest(table(frame, rows), presented=shown).collect()}
    for i, r in found.items():
        assert r["verified"] == (i >= 20 or i % 3 == 0) and r["verified"] == (r["folded_root"] == r["root"])
        assert r["leaf"] == leaf_of(rows[i])
    assert len({r["folded_root"] for r in found.values() if not r["verified"]}) == 13


def test_other_columns_and_no_rows(frame):
    plain = M.merkle_manifest(docs(frame), fields=("doc_id", "text"), group="kept", order="doc_id")
    again = M.merkle_manifest(docs(frame, DOCS[::-1]), fields=("doc_id", "text"), group="kept", order="doc_id")
    assert plain.columns == ["doc_id", "leaf", "subroot", "root", "proof", "path", "folded_root", "verified"]
    assert got(plain, *plain.columns) == got(again, *again.columns)
    assert M.merkle_manifest(table(frame, [])).collect() == []


def test_null_and_empty_differ(frame):
    found = M.merkle_manifest(table(frame, [(1, "a", "", 0, ""), (1, "a", None, None, None)])).collect()
    assert len({r["leaf"] for r in found}) == 2
