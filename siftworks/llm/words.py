"""Words and word shingles of whole Arrow text columns as 64-bit hashes, without a Python loop per word.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as
a-z. Texts are UTF-8, so these are the same words that a split of the decoded
text gives. Hashes are keyed byte polynomials modulo 2**64, mixed afterwards;
two different words get one hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes hashed at once; a longer word is hashed in one piece nevertheless
SHINGLE = 5
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class _Tables(dict):
    """Tables that each process builds for itself; functions sent to tasks leave them behind."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    known = _tables.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        known = _tables[base] = np.cumprod(steps)
    return known[:n]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, and its keyed value with A-Z as a-z."""
    if "letters" not in _tables:
        inside = np.ones(256, bool)
        inside[[0x20, *range(0x09, 0x0E)]] = False
        value = mixed(np.arange(1, 257, dtype=np.uint64))
        value[0x41:0x5B] = value[0x61:0x7B]
        _tables["letters"] = inside, value
    return _tables["letters"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row borders in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, borders, data = column.buffers()
    if not len(column) or borders is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    rows = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, rows - rows[0]


def _cut(raw: np.ndarray, rows: np.ndarray, at: int, inside: np.ndarray) -> int:
    """The first place from ``at`` on that splits no word."""
    if at >= len(raw):
        return len(raw)
    border = int(rows[np.searchsorted(rows, at)])
    while at < border:
        piece = inside[raw[at : min(at + 65536, border)]]
        if not piece.all():
            return at + int(np.argmin(piece))
        at += len(piece)
    return border


def runs(raw: np.ndarray, rows: np.ndarray, lo: int, hi: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero byte kind in ``raw[lo:hi]``; rows end runs."""
    here = kind[raw[lo:hi]]
    change = np.empty(hi - lo + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = here[1:] != here[:-1]
    inner = rows[np.searchsorted(rows, lo, "right") : np.searchsorted(rows, hi)]
    change[inner - lo] = True
    edges = np.flatnonzero(change)
    word = here[edges[:-1]] != 0
    return edges[:-1][word], edges[1:][word]


def hashed_runs(
    raw: np.ndarray, rows: np.ndarray, kind: np.ndarray, value: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every run of one kind, in order."""
    found, lo = [], 0
    while lo < len(raw):
        hi = _cut(raw, rows, lo + SEGMENT, inside)
        start, end = runs(raw, rows, lo, hi, kind)
        terms = value[raw[lo:hi]] * _powers(_BASE, hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        found.append((mixed((total[end] - total[start]) * _powers(_INVERSE, hi - lo)[start]), start + lo, end + lo))
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column and the border of each row in them."""
    inside, value = _letters()
    raw, rows = text_bytes(column)
    hashes, start, _ = hashed_runs(raw, rows, inside.astype(np.uint8), value, inside)
    return hashes, np.searchsorted(start, rows)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words of one row; of all words if there are fewer, nothing without words."""
    n = min(n, len(words))
    if not n:
        return words
    factors = mixed(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total += words[j : j + count] * factors[j]
    return mixed(total)


def row_shingles(column: pa.Array | pa.ChunkedArray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row its distinct shingles in ascending order."""
    words, borders = word_hashes(column)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield np.unique(ngram_hashes(words[a:b], n))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    _, rows = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit values as one Arrow column of long lists."""
    borders = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=borders[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(flat.view(np.int64)))
