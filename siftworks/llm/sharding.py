"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A random order of ``n`` rows is cut into cells, contiguous ranges of places of
bounded length, and each shard is a run of cells. How many rows of a source
partition go to each cell follows from the partition sizes alone: the counts
are a multivariate hypergeometric draw. The matrix is never built. A binary tree
over the partitions splits the cells' free places between its halves with a
draw keyed by the tree node, and each task walks down to its own row of the
matrix, making the same draws as all others on the way. Each task then permutes its rows, deals
them out by its counts, the rows are exchanged once, and each cell is permuted again.

All draws are keyed by the seed, so a task that runs again after a lost executor
does the same. Only ids, sizes and checksums move, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.session import staged

CELL_ROWS = 1 << 16
_NUMPY_MOST = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` are good; beyond numpy's range by inversion around the mode."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if max(good, bad, drawn) < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    width = 14 * int((drawn * (good / total) * (bad / total) * max(1, total - drawn) / max(1, total - 1)) ** 0.5) + 64
    lo, hi = max(0, drawn - bad, mode - width), min(good, drawn, mode + width)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(chances, rng.random() * chances[-1], "right"))


def split_places(rng: np.random.Generator, free: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows go to each cell with so many ``free`` places."""
    taken, rest = np.zeros_like(free), int(free.sum())
    for cell, places in enumerate(free.tolist()):
        rest -= places
        taken[cell] = hypergeometric(rng, places, rest, drawn)
        drawn -= int(taken[cell])
    return taken


def matrix_row(sizes: np.ndarray, cells: np.ndarray, source: int, seed: int) -> np.ndarray:
    """The source partition's row of the communication matrix."""
    borders = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, free = 0, len(sizes), cells.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_places(np.random.default_rng([seed, 1, lo, hi]), free, int(borders[mid] - borders[lo]))
        if source < mid:
            hi, free = mid, left
        else:
            lo, free = mid, free - left
    return free


def even_counts(n: int, parts: int) -> np.ndarray:
    """Counts at most one apart that add up to ``n``."""
    return np.array([n // parts + (i < n % parts) for i in range(parts)], np.int64)


def shuffled_shards(rows: DataFrame, shards: int = 8, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform random order, cut into shards at most one row apart.

    Slots count from 0 without gaps in each shard. Columns are kept, whatever
    they are called besides ``shard`` and ``slot``; nulls and repeated rows are rows
    like others, equal rows being interchangeable. Fewer rows than shards leave
    shards empty, no rows give none. The driver sees one count for each partition.
    """
    names = rows.columns
    held = staged(rows.withColumn("source_", F.spark_partition_id()), "rows")
    found = held.groupBy("source_").count().orderBy("source_").collect()
    places = {r["source_"]: i for i, r in enumerate(found)}
    sizes = np.array([r["count"] for r in found], np.int64)
    shard_sizes = even_counts(int(sizes.sum()), shards)
    cell_counts = [even_counts(int(s), max(1, -(-int(s) // cell_rows))) for s in shard_sizes]
    cells = np.concatenate(cell_counts)
    shard_of = np.repeat(np.arange(shards), [len(c) for c in cell_counts])
    first_slot = np.concatenate([np.cumsum(c) - c for c in cell_counts])

    def ordered(table: pa.Table, key: list[int]) -> pa.Table:
        """The rows in an order that depends on the rows and the key alone."""
        table = table.sort_by([(c, "ascending") for c in names])
        return table.take(pa.array(np.random.default_rng([seed, *key]).permutation(len(table))))

    def deal(table: pa.Table) -> pa.Table:
        source = places[table.column("source_")[0].as_py()]
        counts = matrix_row(sizes, cells, source, seed)
        cell = np.repeat(np.arange(len(cells)), counts)
        return ordered(table, [2, source]).drop_columns(["source_"]).append_column("cell_", pa.array(cell, pa.int64()))

    def place(table: pa.Table) -> pa.Table:
        cell = table.column("cell_")[0].as_py()
        slot = first_slot[cell] + np.arange(len(table))
        table = ordered(table, [3, cell]).drop_columns(["cell_"])
        table = table.append_column("shard", pa.array(np.full(len(table), shard_of[cell]), pa.int32()))
        return table.append_column("slot", pa.array(slot, pa.int64()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = held.groupBy("source_").applyInArrow(deal, f"{columns}, cell_ long")
    return dealt.groupBy("cell_").applyInArrow(place, f"{columns}, shard int, slot long")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs (doc_id, text)``.

    The law is ``rows``: shard counts are at most one apart. ``size`` is the text's
    UTF-8 bytes plus 1; a null text has no bytes and the checksum of the empty text.
    ``grown_shard`` is null, as one more shard means a new shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffled_shards(rows, shards, seed, cell_rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
