from __future__ import annotations

from cases import DOCS, LONG, docs, got, prose
from test_near_dedup import shingles

from siftworks.llm.decontamination import contained_items

ITEMS = [
    (1, " ".join(LONG.split()[20_000:20_030])),
    (2, prose(1, 120)),
    (3, "BAN  ker"),
    (4, None),
    (5, ""),
    (6, prose(77, 25)),
    (7, prose(2, 60) + " " + prose(78, 15)),
    (7, "ban ker"),
    (None, "ban ker"),
]


def brute(rows, items):
    pairs = []
    for doc, text in rows:
        own = shingles(text)
        for item, wanted in {(i, t) for i, t in items if i is not None}:
            wanted = shingles(wanted)
            if doc is not None and wanted and 100 * len(own & wanted) >= 75 * len(wanted):
                pairs.append((doc, item, len(wanted), len(own & wanted)))
    return sorted(pairs, key=lambda r: tuple((False, str(x)) for x in r))


def test_pairs_against_brute_force_in_one_and_many_lots(frame):
    words = LONG.split()
    scattered = " ".join(" ".join(words[k : k + 9]) + f" x{k}" for k in range(100, 1000, 9))
    rows = DOCS + [(30, prose(77, 25) + " " + prose(79, 400)), (31, prose(80, 300) + " " + prose(77, 25)[:-4]), (32, scattered)]
    items = ITEMS + [(8, " ".join(words[100:1000]))]
    items_df = frame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    wanted = brute(rows, items)
    assert len(wanted) > 6
    for lot in (1000, 3):
        assert got(contained_items(docs(frame, rows), items_df, lot=lot), "doc_id", "item_id", "n_shingles", "n_found") == wanted


def test_empty_tables(frame):
    none = frame([], "item_id long, text string")
    assert got(contained_items(docs(frame), none), "doc_id") == []
    assert got(contained_items(docs(frame, []), frame(ITEMS, "item_id long, text string")), "doc_id") == []
