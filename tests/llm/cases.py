"""Small inputs with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "n r s t l m d k p g".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(99, 30_000)

# id, text: null and empty texts, white space, few words, a very long text, copies, repeated rows, no id
DOCS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "ban ker"),
    (7, "ban ker"),
    (8, LONG),
    (9, prose(2, 60)),
    (9, prose(2, 60)),
    (10, "é 日本 ▁ 🎉 ban"),
    (None, prose(3, 40)),
    (None, None),
]


def docs(frame, rows=None, clash: str = "score string, blob string, node string, shard string, slot string, kept string"):
    """``(doc_id, text)`` with extra columns that carry names the operators use themselves."""
    rows = DOCS if rows is None else rows
    extra = tuple("x" for _ in clash.split(","))
    return frame([(*r, *extra) for r in rows], f"doc_id long, text string, {clash}")


def got(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
