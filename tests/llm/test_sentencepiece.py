from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import DOCS, docs, got
from hypothesis import given, settings
from hypothesis import strategies as st

from siftworks.llm import sentencepiece_bpe as B
from siftworks.llm.queries import PIECES
from siftworks.llm.words import mixed

MODEL = B.read_model(PIECES)
PLAIN, DROPPED = B.Codec(MODEL, 0.0), B.Codec(MODEL, 0.3, seed=5)
PUBLIC = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
texts = st.lists(st.one_of(st.none(), st.text(alphabet="theaon \n\té日🎉.,", max_size=60)), max_size=6)


def rows(codec, values):
    ids, borders = codec.encode(pa.array(values, pa.string()), mixed(np.arange(len(values), dtype=np.uint64)))
    return [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)]


@settings(deadline=None, max_examples=80)
@given(texts)
def test_without_dropout_the_ids_are_the_librarys(values):
    assert rows(PLAIN, values) == [PUBLIC.encode(v or "") for v in values]


@settings(deadline=None, max_examples=80)
@given(texts)
def test_dropout_decodes_losslessly(values):
    found = rows(DROPPED, values)
    assert [DROPPED.decode(x) for x in found] == [v or "" for v in values]
    assert [PUBLIC.decode(x) for x in found] == [v or "" for v in values]
    assert found == rows(DROPPED, values)


def test_the_sign_for_a_space_survives():
    values = ["▁", "a▁b ▁", "▁▁ x"]
    assert [PLAIN.decode(x) for x in rows(PLAIN, values)] == values


def test_seeds_and_places_vary_segmentations():
    text = "and another thing about the nation " * 50
    assert len({tuple(rows(B.Codec(MODEL, 0.3, seed=s), [text])[0]) for s in range(4)}) == 4
    parts = rows(DROPPED, [text])[0]
    assert len(parts) > len(rows(PLAIN, [text])[0])


def test_dropped_share_follows_the_rate():
    text = " th" * 20_000  # its only merges: a space with t, t with h, and both
    ids = rows(B.Codec(MODEL, 0.25, seed=1, variants=10**6), [text])[0]
    whole = sum(i == PUBLIC.piece_to_id("▁th") for i in ids) / 20_000
    assert 0.5 < whole < 0.85


def test_every_place_draws_at_the_default_rate():
    n = 40_000
    ids = rows(B.Codec(MODEL), [" th" * n])[0]
    share = {piece: ids.count(PUBLIC.piece_to_id(piece)) / n for piece in ("▁t", "t", "th")}
    # a space with t merges first: made and the whole left out, left out with t and h, left out and the whole too
    assert abs(share["▁t"] - 0.9 * 0.1) < 0.006
    assert abs(share["t"] - 0.1 * 0.1) < 0.003
    assert abs(share["th"] - 0.1 * 0.9 * 0.1) < 0.003


def test_rounds_leave_ids_alone(monkeypatch):
    values = ["and another thing\n\nabout é🎉 the nation " * 20, "", None, "then"]
    whole = rows(DROPPED, values)
    monkeypatch.setattr(B, "ROUND", 7)
    assert rows(DROPPED, values) == whole


def test_table(frame):
    encoded = B.encode_texts(docs(frame), MODEL)
    assert all(r["lossless"] for r in encoded.collect())
    assert got(B.decode_texts(encoded, MODEL), "doc_id", "text") == sorted(
        ((d, t or "") for d, t in DOCS), key=lambda r: tuple((x is None, str(x)) for x in r)
    )
    assert B.encode_texts(docs(frame, []), MODEL).collect() == []


def test_a_model_without_byte_pieces_is_refused(monkeypatch):
    class Model:
        def __init__(self, model_proto):
            pass

        def get_piece_size(self):
            return 1

        id_to_piece = staticmethod(lambda i: "a")
        is_byte = is_control = is_unknown = staticmethod(lambda i: False)

    monkeypatch.setattr(B.sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="byte pieces"):
        B.Codec(b"")
