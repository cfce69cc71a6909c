"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with it, so
documents are cut into blocks of the item's size: items are partitioned by their
number of shingles into classes, the powers of two, and each class meets MinHash signatures
of blocks of that many shingles. Signatures of larger blocks are minima over smaller ones. An item and
a document that agree in any sample in any block are a candidate, and the document's full
shingle set decides. With 64 samples an item whose shingles lie in a document
to the asked share is missed with a probability of about 1e-8, wherever in the document they lie.

Items are met in lots of bounded size, so what is broadcast is bounded; more items mean more
passes over the documents. Nothing is shuffled and no document leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.words import SHINGLE, mixed, ngram_hashes, row_shingles, slices, word_hashes

PERCENT = 75
SAMPLES = 64
LOT = 20_000
_PIECE = 4096
_SIEVE = 20


def _keys(samples: int) -> tuple[np.ndarray, np.ndarray]:
    keys = mixed(np.arange(7001, 7001 + samples, dtype=np.uint64))
    return (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1), keys.astype(np.uint32)


def block_class(size: int) -> int:
    """The smallest power of two that holds the item."""
    return 1 << max(0, size - 1).bit_length()


def _blocks(shingles: np.ndarray, first: int, last: int, samples: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(block size, minima of every block under each sample)`` for the powers of two from ``first`` to ``last``."""
    factor, offset = _keys(samples)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(_PIECE, last)
    for a in range(0, len(low), step):
        hashed = low[a : a + step, None] * factor + offset
        size, least = first, np.minimum.reduceat(hashed, np.arange(0, len(hashed), first), axis=0)
        while True:
            yield size, least
            if size >= last:
                break
            least = np.minimum.reduceat(least, np.arange(0, len(least), 2), axis=0)
            size *= 2


class _Index:
    """Signatures of a lot of items by class, and their full sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], samples: int):
        self.items, self.samples = items, samples
        factor, offset = _keys(samples)
        place = np.arange(samples, dtype=np.uint64) << np.uint64(32)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, own) in enumerate(items):
            low = (own >> np.uint64(32)).astype(np.uint32)
            least = (low[:, None] * factor + offset).min(axis=0).astype(np.uint64) | place
            found.setdefault(block_class(len(own)), []).append((least, np.full(samples, k)))
        self.classes = {}
        for size, lists in found.items():
            keys, owners = (np.concatenate(x) for x in zip(*lists, strict=True))
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[self.sieved(keys)] = True
            self.classes[size] = keys[order], owners[order], sieve
        self.place = place

    @staticmethod
    def sieved(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE)

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that agree with some block of a document's shingles, given in text order."""
        found: set[int] = set()
        if not self.classes:
            return found
        for size, least in _blocks(shingles, min(self.classes), max(self.classes), self.samples):
            if size not in self.classes:
                continue
            keys, owners, sieve = self.classes[size]
            seen = (least.astype(np.uint64) | self.place).ravel()
            seen = np.unique(seen[sieve[self.sieved(seen)]])
            lo, hi = np.searchsorted(keys, seen), np.searchsorted(keys, seen, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(owners[a:b].tolist())
        return found


def _item_lots(items: DataFrame, n: int, lot: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their shingle sets, at most ``lot`` at a time on the driver; items without words or id have none."""

    def texts(rows) -> list[tuple[int, np.ndarray]]:
        sets = row_shingles(pa.array([r[1] for r in rows], pa.string()), n)
        return [(r[0], s) for r, s in zip(rows, sets, strict=True) if len(s)]

    rows = []
    named = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    for row in named.toLocalIterator():
        rows.append(row)
        if len(rows) == lot:
            yield texts(rows)
            rows = []
    if rows:
        yield texts(rows)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    n: int = SHINGLE,
    samples: int = SAMPLES,
    lot: int = LOT,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found)``: items of which a document holds at least ``percent`` of the shingles.

    ``docs (doc_id, text)`` and ``items (item_id, text)`` may have other columns,
    which are ignored. Shingles are runs of ``n`` words, A-Z as a-z; a shorter text is one
    shingle. Null, empty and wordless texts hold nothing and are in nothing; so are
    rows of ``docs`` without an id and items without one. A repeated document row repeats its pairs; an item given
    twice with two texts is looked for with both. Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = []
    for items_now in _item_lots(items, n, lot):
        shared = docs.sparkSession.sparkContext.broadcast(items_now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _Index(shared.value, samples)
            for whole in batches:
                for batch in slices(whole, "text"):
                    words, borders = word_hashes(batch.column("text"))
                    ids = batch.column("doc_id").to_pylist()
                    found = []
                    for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                        shingles = ngram_hashes(words[a:b], n)
                        near = index.candidates(shingles)
                        own = np.unique(shingles) if near else shingles
                        for i in sorted(near):
                            item, wanted = index.items[i]
                            both = len(np.intersect1d(own, wanted, assume_unique=True))
                            if 100 * both >= percent * len(wanted):
                                found.append((ids[k], item, len(wanted), both))
                    columns = list(zip(*found, strict=True)) if found else [[]] * 4
                    names = ("doc_id", "item_id", "n_shingles", "n_found")
                    yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(names, columns, strict=True)})

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
