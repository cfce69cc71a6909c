from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, docs, got

from siftworks.llm import token_alignment as T
from siftworks.llm.queries import BYTE_BPE, PIECES

MODELS = T.read_vocabularies(BYTE_BPE, PIECES)
A, B = T.ByteBpe(MODELS[0]), T.Pieces(MODELS[1])
ROWS = [
    *DOCS,
    (20, "naïve café: the model's tokens, 3.14 and so on"),
    (21, "<|endoftext|> <s> </s> <unk> <0x41> is plain text"),
    (22, "ab▁cd"),
    (23, "▁"),
    (24, "  two  spaces\n\nand\ttabs \r\n"),
    (25, "a" * 5000 + "é" * 3000 + " " * 2000),
    (26, "\x00\x01"),
]


def brute_force(rows):
    """Tokens one by one, byte by byte."""
    per_row, corpus = [], Counter()
    for doc_id, text in rows:
        a, b = ([x.tolist() for x in c.encode([t])][0] if text else [] for c, t in ((A, " " + (text or "")), (B, text or "")))
        spell = lambda c, ids: [c.tokens.bytes[c.tokens.starts[i] : c.tokens.starts[i] + c.tokens.lengths[i]].tobytes() for i in ids]
        a_bytes, b_bytes = spell(A, a), spell(B, b)
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        groups, links, i, j = [], [], 0, 0
        while i < len(a):
            group, a_end, b_end = ([], []), 0, 0
            while not (a_end == b_end and a_end):
                if a_end <= b_end:
                    group[0].append(a[i])
                    a_end, i = a_end + len(a_bytes[i]), i + 1
                else:
                    group[1].append(b[j])
                    b_end, j = b_end + len(b_bytes[j]), j + 1
            groups.append(group)
            links.append((group[0][-1], group[1][-1]))
        corpus.update(links)
        per_row.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    result = []
    for doc_id, n_a, n_b, groups, links in per_row:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if n_a else ""
        best = sum(corpus[x] == most[x[1]] for x in links)
        shared = sum(len(x) * len(y) for x, y in groups)
        result.append((doc_id, n_a, n_b, len(groups), len(links), shared, digest, best, sum(corpus[x] for x in links)))
    return sorted(result, key=lambda r: tuple((x is None, str(x)) for x in r))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(frame, parts):
    found = T.count_links(T.align(docs(frame, ROWS).repartition(parts), MODELS))
    assert got(found, *COLUMNS) == brute_force(ROWS)


def test_no_rows_and_no_tokens(frame):
    for rows in ([], [(1, None), (2, ""), (None, "▁▁")]):
        found = T.count_links(T.align(docs(frame, rows), MODELS)).collect()
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(d) for d, _ in rows)
        assert all(r["n_a"] == r["n_b"] == r["n_links"] == r["count_sum"] == 0 and r["groups_sha256"] == "" for r in found)


def test_vocabularies_spell_their_texts():
    assert A.tokens.spell(A.encode([" naïve 🎉"])[0]).tobytes().decode() == " naïve 🎉"
    assert B.tokens.spell(B.encode(["naïve 🎉\n"])[0]).tobytes().decode() == " naïve 🎉\n"


def test_both_engines_give_the_same_tokens():
    """Every code point beside letters, digits, spaces and itself; a sample of three in a thousand, and all of the first plane's start."""
    points = [*range(0x3100), *range(0x3100, 0xD800, 331), *range(0xE000, 0x110000, 331)]
    for i in range(0, len(points), 2048):
        texts = [f"a{c}b {c} 1{c}2 {c}{c}\n{c}.  {c}" for c in map(chr, points[i : i + 2048])]
        slow = A.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert all(x.tolist() == y.ids for x, y in zip(A.encode(texts), slow, strict=True))
    blank = "x" + " \n" * 400_000 + "y"
    assert A.tokens.spell(A.encode([blank])[0]).tobytes().decode() == blank


def test_products_against_dense_matrices():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        x, y = rng.random((n, k)) < 0.4, rng.random((m, k)) < 0.4
        sparse = [T.from_entries(*np.nonzero(z), z.shape) for z in (x, y)]
        found = T.product(sparse[0], T.transposed(sparse[1]))
        dense = np.zeros((n, m), int)
        dense[found.rows, found.columns] = found.values
        assert (dense == x.astype(int) @ y.astype(int).T).all()


def test_overlaps_across_column_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    cuts = lambda: np.append(np.unique(rng.integers(1, 200, 40)), 200)
    a, b = cuts(), cuts()
    whole = T.overlap_links(a, b)
    assert whole[2].sum() == 200
    for columns in (1, 7, 64):
        monkeypatch.setattr(T, "COLUMNS", columns)
        assert all((x == y).all() for x, y in zip(T.overlap_links(a, b), whole, strict=True))


@pytest.mark.parametrize("entries", [1, 5, 1000])
def test_group_links_in_blocks(entries):
    a, b = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 1, 1, 1, 2, 2])
    found = {(int(i), int(j)) for x, y in T.group_links(a, b, entries) for i, j in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(6) for j in range(6) if a[i] == b[j]}


def test_link_tables(frame):
    table = docs(frame, ROWS)
    counted = {
        r["doc_id"]: r for r in T.count_links(T.align(table, MODELS)).where("doc_id > 19").collect()
    }
    for kind, column in (("overlap", "n_overlaps"), ("end", "n_links"), ("group", "n_shared")):
        links = T.link_table(table, MODELS, kind).where("doc_id > 19").collect()
        assert Counter(r["doc_id"] for r in links) == Counter({d: r[column] for d, r in counted.items() if r[column]})
        assert all(r["weight"] > 0 for r in links)
    with pytest.raises(ValueError):
        T.link_table(table, MODELS, "near")


def test_numbers_of_pairs():
    numbers = T.PairNumbers()
    first, second = numbers.add(np.array([9, 4, 9, 7])), numbers.add(np.array([4, 1, 9]))
    keys = numbers.by_number()
    assert keys[first].tolist() == [9, 4, 9, 7] and keys[second].tolist() == [4, 1, 9]
    assert dict(zip(keys.tolist(), numbers.counts.tolist(), strict=True)) == {9: 3, 4: 2, 7: 1, 1: 1}
