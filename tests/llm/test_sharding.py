from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, docs, got

from siftworks.llm import sharding as S


@pytest.mark.parametrize("cell_rows", [2, 1000])
def test_every_row_has_one_place(frame, cell_rows):
    rows = DOCS + [(i, f"t{i % 3}") for i in range(100, 170)]
    result = S.shard_documents(docs(frame, rows).repartition(5), 8, 3, cell_rows)
    assert result.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = result.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    again = S.shard_documents(docs(frame, rows).repartition(5), 8, 3, cell_rows)
    assert got(again, *again.columns) == got(result, *result.columns)


def test_few_and_no_rows(frame):
    assert Counter(r["shard"] for r in S.shard_documents(docs(frame, DOCS[:3])).collect()) == {0: 1, 1: 1, 2: 1}
    assert S.shard_documents(docs(frame, [])).collect() == []


def test_matrix_has_exact_rows_and_columns():
    sizes, cells = np.array([5, 0, 17, 3, 9]), np.array([10, 9, 0, 15])
    matrix = np.array([S.matrix_row(sizes, cells, i, 7) for i in range(5)])
    assert matrix.sum(axis=1).tolist() == sizes.tolist() and matrix.sum(axis=0).tolist() == cells.tolist()


def test_places_are_uniform():
    counts = np.array([S.matrix_row(np.array([20, 60]), np.array([40, 40]), 0, seed)[0] for seed in range(2000)])
    assert abs(counts.mean() - 10) < 0.2 and abs(counts.var() - 20 * 0.25 * 60 / 79) < 0.5


def test_draws_beyond_numpys_range():
    rng = np.random.default_rng(1)
    good, bad, drawn = 3 * 10**9, 5 * 10**9, 2 * 10**9
    draws = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(200)])
    mean, var = drawn * 3 / 8, drawn * 3 / 8 * 5 / 8 * 0.75
    assert abs(draws.mean() - mean) < 5 * (var / 200) ** 0.5 and 0.7 < draws.var() / var < 1.4
