from __future__ import annotations

import random
import re

from cases import DOCS, docs, got, prose

from siftworks.llm.components import components
from siftworks.llm.near_dedup import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[j][0] is not None
            both = len(sets[i] & sets[j])
            if same and sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(doc, groups.get(find(i), doc))
    return [(d, len(s), groups[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(frame, rows, **how):
    result = near_duplicates(docs(frame, rows), **how)
    found = got(result, "doc_id", "n_shingles", "component_id", "kept")
    wanted = [(*r, r[0] is None or r[0] == r[2]) for r in brute(rows)]
    assert found == sorted(wanted, key=lambda r: tuple((x is None, str(x)) for x in r))


def edited(text, seed, share):
    rng, words = random.Random(seed), text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = "X%d" % rng.randrange(10**6)
    return " ".join(words)


def test_awkward_rows(frame):
    check(frame, DOCS)


def test_empty_table(frame):
    assert got(near_duplicates(docs(frame, [])), "doc_id") == []


def test_near_copies_in_blocks_against_all_pairs(frame):
    base = prose(50, 200)
    rows = [(i, edited(base, i, 0.012 * (i % 5))) for i in range(60)] + [(100 + i, edited(prose(51, 80), i, 0.04)) for i in range(20)]
    # blocks of 8, so that the cluster needs several and nodes outside its main group meet all of them
    check(frame, rows, block=8)


def test_texts_of_one_id_are_compared_as_their_own(frame):
    bases = [prose(60 + k, 100) for k in range(6)]
    # all base texts have id 7, and each has near copies and an exact one with ids of their own
    rows = [(7, b) for b in bases] + [(20 + k, edited(b, k, 0.02)) for k, b in enumerate(bases)]
    rows += [(k, edited(b, 9 + k, 0.02)) for k, b in enumerate(bases[:3])] + [(30, bases[5]), (7, bases[1])]
    check(frame, rows)
    check(frame, rows, block=2)


def test_components_of_a_chain(frame):
    edges = frame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert got(components(edges, "a", "b"), "node", "component") == sorted(
        [(i, 0) for i in range(41)] + [(100, 100), (101, 100)], key=lambda r: tuple((x is None, str(x)) for x in r)
    )
