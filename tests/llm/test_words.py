from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from siftworks.llm import words as W

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b é日", max_size=40)), max_size=8)


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lower)


@settings(deadline=None, max_examples=60)
@given(texts)
def test_words_are_those_of_the_decoded_text(rows):
    hashes, borders = W.word_hashes(pa.array(rows, pa.string()))
    known = {}
    for text, a, b in zip(rows, borders[:-1], borders[1:], strict=True):
        own = split(text)
        assert len(own) == b - a
        for word, h in zip(own, hashes[a:b].tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_sliced_columns_and_texts_beyond_a_segment():
    text = "ab " * 500_000 + "c" * 1_200_000 + " ab"
    column = pa.array(["x", text, None, "ab"]).slice(1)
    hashes, borders = W.word_hashes(column)
    assert borders.tolist() == [0, 500_002, 500_002, 500_003]
    assert len(set(hashes.tolist())) == 2


def test_short_texts_are_one_shingle():
    sets = list(W.row_shingles(pa.array(["a b", "a b", "a b c d e f", "", None])))
    assert [len(x) for x in sets] == [1, 1, 2, 0, 0]
    assert np.array_equal(sets[0], sets[1])


def test_functions_sent_to_tasks_leave_tables_behind():
    W.word_hashes(pa.array(["some words"]))
    assert len(cloudpickle.dumps(W.word_hashes)) < 100_000
