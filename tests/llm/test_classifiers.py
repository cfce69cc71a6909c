from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, docs, got, prose

from siftworks.llm import quality as Q
from siftworks.llm import toxicity as T

INSULTS = ["zwarg", "zwargen", "zwargol", "blomf"]


def corpus(n=240):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        words = prose(1000 + i, 40).split()
        if bad:
            words = [w + "&&&" for w in words]
        if toxic:
            words[7], words[19] = INSULTS[i % 4], INSULTS[(i + 1) % 4]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


ROWS, LABELS = corpus()
HELD = {i for i, _ in ROWS if zlib.crc32(str(i).encode()) % 3 == 1}


@pytest.fixture(scope="module")
def tables(frame):
    labels = frame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    return docs(frame, ROWS), labels


def correct(df, column):
    marks = {r[0]: r[column] for r in LABELS}
    held = [r for r in df.collect() if r["held_out"]]
    assert {r["doc_id"] for r in held} == HELD and all(0 <= r["score"] <= 1 for r in held)
    return np.mean([r["predicted"] == marks[r["doc_id"]] for r in held])


def test_quality_of_held_out_rows(tables, frame):
    table, labels = tables
    weights = Q.fit(table, labels)
    scored = Q.score(table, weights)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert correct(scored, 1) >= 0.95
    odd = Q.score(docs(frame), weights).collect()
    assert len(odd) == len(DOCS) and all(r["score"] is not None for r in odd)
    assert not any(r["held_out"] for r in odd if r["doc_id"] is None)
    kept = Q.keep_good(table, weights)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored.collect() if r["predicted"]}
    assert Q.score(docs(frame, []), weights).collect() == []


def test_held_out_labels_teach_nothing(tables, frame):
    table, _ = tables
    turned = frame([(i, 1 - q if i in HELD else q, t) for i, q, t in LABELS], "doc_id long, quality int, toxic int")
    plain = frame(LABELS, "doc_id long, quality int, toxic int")
    assert np.array_equal(Q.fit(table, turned), Q.fit(table, plain))


def test_without_labels_scores_are_even(tables, frame):
    none = frame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.score(tables[0], Q.fit(tables[0], none)).collect()} == {0.5}
    assert T.learn(tables[0], none).stems == {}


def test_score_is_the_sparse_dot_product():
    text = "The cat, the cat!! 12"
    weights = np.random.default_rng(0).standard_normal(1 << 10)
    buckets, borders = Q.features(pa.array([text, ""]), 10)
    x = np.bincount(buckets[: borders[1]], minlength=1 << 10) * Q.SCALE / borders[1]
    wanted = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (weights @ x, weights[0] * Q.SCALE)]
    assert np.allclose(Q._scores(pa.array([text, ""]), weights, 10), wanted)


def test_toxicity_of_held_out_rows(tables, frame):
    table, labels = tables
    grammar = T.learn(table, labels)
    assert "blomf$" in grammar.stems and any("zwargen".startswith(s) for s in grammar.stems)
    scored = T.score(table, grammar)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert correct(scored, 2) >= 0.95
    odd = T.score(docs(frame), grammar).collect()
    assert len(odd) == len(DOCS) and all(r["predicted"] == 0 for r in odd)
    assert T.score(docs(frame, []), grammar).collect() == []


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("we saw a blomf there", [("insult", "plain")]),
        ("he is not a blomf", [("insult", "negated")]),
        ("never mind the weather of a blomf", [("insult", "plain")]),
        ("it was said a blomf lives there", [("insult", "reported")]),
        ('she wrote. a blomf', [("insult", "plain")]),
        ("the “blomf” word", [("insult", "reported")]),
        ("you blomf", [("insult", "aimed")]),
        ("blomf are you", [("insult", "aimed")]),
        ("i will kill you", [("threat", "aimed")]),
        ("they kill time", [("threat", "aimed")]),
        ("kill the process", []),
        ("xblomf blomfy", []),
    ],
)
def test_contexts_of_a_clause(text, wanted):
    machine = T.automaton({"blomf$": (6.0, 0.0)})
    assert [(kind, context) for _, kind, context, _, _ in T.text_events(text, machine)] == wanted


def test_chance_matches_of_a_long_text_do_not_add_up():
    grammar = T.Grammar({"ba": (3.0, 0.01)})
    event = (0, "insult", "plain", 3.0, "ba")
    assert T.text_score([event] * 100, 10_000, grammar) == grammar.floor
    assert T.text_score([event] * 100, 100, grammar) > 0.99
    assert T.text_score([], 0, grammar) == grammar.floor


def test_learnt_stems_prefer_the_longest_of_equals_and_shorter_ones_count_the_rest():
    counts = {"idi": (50, 0), "idiot": (50, 0), "idiot$": (50, 0), "zwa": (60, 1), "zwar$": (9, 0), "the": (90, 400)}
    stems = T.choose_stems(counts, 100, 500, 10_000)
    assert set(stems) == {"idiot$", "zwa"} or set(stems) == {"idiot$", "zwa", "zwar$"}


def test_scores_repeat(tables):
    grammar = T.learn(*tables)
    assert got(T.score(tables[0], grammar), "doc_id", "score") == got(T.score(tables[0], T.learn(*tables)), "doc_id", "score")
