from __future__ import annotations

import random
import re

import numpy as np
import pytest
from cases import DOCS, docs, got

from siftworks.llm import license_scan as L


def words(text):
    return [m for m in re.finditer(r"[0-9a-zA-Z]+|[^\x00-\x7f]+", text)]


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_the_longest_common_subsequence(seed):
    rng = random.Random(seed)
    template = [rng.randrange(30) for _ in range(rng.randint(5, 50))]
    text = list(template)
    for _ in range(rng.randint(0, 6)):
        k = rng.randrange(len(text))
        text[k : k + rng.randrange(2)] = [99] * rng.randrange(2)
    lead = [200] * rng.randrange(12)
    found = L.aligned(np.array(template), np.array(lead + text + [300] * 4), len(lead) - 8, 20)
    assert len(found) == longest(template, lead + text) and found == sorted(set(found))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 50])
def test_windows_share_a_fingerprint(n):
    grams = np.random.default_rng(n).integers(0, 20, n).astype(np.uint64)
    places = set(L.winnowed(grams).tolist())
    for a in range(max(1 if n else 0, n - L.WINDOW + 1)):
        own = range(a, min(n, a + L.WINDOW))
        assert any(grams[p] == min(grams[q] for q in own) for p in places.intersection(own))


def test_spans_and_coverage(spark, frame):
    name, text = "MIT", L.TEMPLATES["MIT"]
    changed = text.replace("person", "body").replace("free of charge", "for nothing")
    notice = L.TEMPLATES["GPL-3.0-notice"]
    rows = [
        (50, f"é 日本 ban ker. {text} And so on."),
        (51, f"{notice}\n{notice.upper()}\n{notice}"),
        (52, f"ban {changed} ker"),
        (53, text[: len(text) // 2]),
    ]
    found = L.scan_licenses(docs(frame, DOCS + rows), L.template_table(spark))
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {50, 51, 52}
    (whole,) = [r for r in by_doc[50] if r["template"] == name]
    at = rows[0][1].index(text)
    assert (whole["start"], whole["end"], whole["coverage"]) == (at, at + len(text) - 1, 1.0)
    assert sorted((r["start"], r["coverage"]) for r in by_doc[51]) == [(k * (len(notice) + 1), 1.0) for k in range(3)]
    (part,) = [r for r in by_doc[52] if r["template"] == name]
    same = longest([w.group().lower() for w in words(text)], [w.group().lower() for w in words(rows[2][1])])
    assert part["n_matched"] == same < part["n_words"]


ENDS = {
    "MIT": ("THE SOFTWARE IS", "OTHER DEALINGS IN THE SOFTWARE"),
    "ISC": ("THE SOFTWARE IS", "PERFORMANCE OF THIS SOFTWARE"),
    "BSD-2-Clause": ("THIS SOFTWARE IS", "POSSIBILITY OF SUCH DAMAGE"),
    "GPL-3.0-header": ("You should have", "www.gnu.org/licenses"),
}


def test_whole_licences_and_their_first_parts(spark, frame):
    rows = []
    for k, (name, (later, last)) in enumerate(ENDS.items()):
        text = L.TEMPLATES[name]
        rows += [(k, f"ban ker {text} ban ker"), (10 + k, f"ban ker {text[: text.index(later)]} ban ker")]
    found = L.scan_licenses(docs(frame, rows), L.template_table(spark), 0.2).collect()
    for k, (name, (_, last)) in enumerate(ENDS.items()):
        (whole,) = [r for r in found if (r["doc_id"], r["template"]) == (k, name)]
        text = rows[2 * k][1]
        assert (whole["coverage"], whole["start"], whole["end"]) == (1.0, 8, text.index(last) + len(last))
        (part,) = [r for r in found if (r["doc_id"], r["template"]) == (10 + k, name)]
        assert 0.2 <= part["coverage"] < 1


def test_short_templates_need_no_run_of_words(spark, frame):
    table = L.template_table(spark, L.TEMPLATES | {"one": "Unlicense", "two": "Public Domain"})
    apache, mit = "Licensed under Apache License 2.0", "Released under MIT License"
    rows = [(1, f"ban ker {apache}. ban"), (2, f"ban {mit}, ker"), (3, f"{mit}. {mit}.\n{L.TEMPLATES['MIT-notice']} {mit}")]
    rows += [(4, "ban public domain ker unlicense ban"), (5, "the license under ban released ker mit the license")]
    found = L.scan_licenses(docs(frame, DOCS + rows), table)
    spans = got(found, "doc_id", "template", "coverage", "start", "end")
    assert [r for r in spans if r[0] == 1] == [(1, "Apache-2.0-notice", 0.75, 8, 8 + len(apache))]
    assert [r for r in spans if r[0] == 2] == [(2, "MIT-notice", 0.8, 4, 4 + len(mit))]
    places = [(0, 0.8), (28, 0.8), (56, 1.0), (88, 0.8)]
    assert [(r[3], r[2]) for r in spans if r[0] == 3] == [(a, c) for c, a in sorted((c, a) for a, c in places)]
    assert [r[1:] for r in spans if r[0] == 4] == [("one", 1.0, 22, 31), ("two", 1.0, 4, 17)]
    assert {r[0] for r in spans} == {1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(20))
def test_every_short_occurrence_is_found(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.randint(1, L.SHORT))]
    known = L._Templates([("t", " ".join(words))])
    own, lead, text = known.words[0], rng.randrange(50), list(known.words[0])
    for i in rng.sample(range(len(own)), len(own) // 4):
        text[i] = 7 + i
    text = np.array([1] * lead + text + [2] * 30, np.uint64)
    ((_, matched, first, last),) = known.find(text, 0.75)
    assert matched == len(own) - len(own) // 4
    assert lead <= first <= last < lead + len(own)


def test_lots_and_empty_tables(spark, frame):
    table = docs(frame, [(1, " ".join(L.TEMPLATES.values()))])
    columns = ("template", "n_matched", "start", "end")
    every = got(L.scan_licenses(table, L.template_table(spark)), *columns)
    assert got(L.scan_licenses(table, L.template_table(spark), lot=3), *columns) == every
    assert {r[0] for r in every} == set(L.TEMPLATES)
    assert L.scan_licenses(table, L.template_table(spark).where("false")).collect() == []
    assert L.scan_licenses(table.where("false"), L.template_table(spark)).collect() == []
