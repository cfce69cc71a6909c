"""Near-duplicate documents: banded MinHash, odd sketches, exact Jaccard on full shingle sets.

1. One pass over the texts gives each document a digest of its distinct word
   shingles, a MinHash signature cut into bands, and an odd sketch: every
   MinHash sample flips one bit of a bitmap, so that the population count of
   the XOR of two bitmaps tells how many samples differ.
2. Documents with one digest are one node, known by a number of its own; texts that share an id are different nodes.
3. Nodes that share a band hash are tied to the smallest node of that bucket; a
   bucket of two is first verified by its sketches. The connected parts are clusters.
4. Each cluster is compared in blocks of bounded size within tasks. Pairs whose
   sketches are too far apart are left out, the others are decided on full sets.
   Only nodes outside the cluster's largest group so far meet all other blocks, so
   copies of one text are never compared with each other pair by pair.

Links are confirmed exactly: ``100 * intersection >= 100 * threshold * union``.
With 32 bands of 4 samples a pair at 0.75 shares no band with probability 5e-6,
and the sketch rejects it with one of about 3e-5; both fall fast above 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.components import components
from siftworks.llm.words import SHINGLE, long_lists, mixed, row_shingles, slices
from siftworks.session import staged

PERCENT = 75
BANDS, DEPTH = 32, 4
SAMPLES = BANDS * DEPTH
SKETCH_BITS = 512
BLOCK = 512

SIGNED = "doc_id long, text_key long, n_shingles long, digest binary, sketch array<long>, bands array<long>"


def farthest(percent: int = PERCENT, samples: int = SAMPLES, bits: int = SKETCH_BITS, z: float = 4.0) -> int:
    """The largest XOR population count that a pair at the threshold reaches but for chance (``z`` deviations)."""
    j = percent / 100
    differ = 2 * (samples * (1 - j) + z * sqrt(samples * j * (1 - j)))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** differ)
    return int(mean + z * sqrt(mean) / 2) + 1


def min_hashes(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The smallest of the hashed shingles under each of ``samples`` keyed functions."""
    keys = mixed(np.arange(1, samples + 1, dtype=np.uint64))
    factor, offset = (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1), keys.astype(np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(least, (low[a : a + 2048, None] * factor + offset).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of how many samples fall on each bit, as 64-bit words."""
    place = mixed(least.astype(np.uint64) << np.uint64(16) ^ np.arange(len(least), dtype=np.uint64)) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8).view(np.int64)


def band_hashes(least: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One hash for each band of ``depth`` samples, different bands never meeting."""
    rows = least.astype(np.uint64).reshape(-1, depth)
    total = mixed(np.arange(1, len(rows) + 1, dtype=np.uint64))
    for j in range(depth):
        total = mixed(total ^ rows[:, j])
    return total.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a sorted set of hashes."""
    turn = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([mixed(shingles).sum(), turn.sum() ^ np.uint64(len(shingles))], np.uint64)
    return both.tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a hash of the text, which tells the texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def signed(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Digest, sketch and band hashes of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(row_shingles(batch.column("text"), n))
                least = [min_hashes(x) if len(x) else None for x in sets]
                none = np.zeros(0, np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "text_key": batch.column("text_key"),
                        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                        "digest": pa.array([digest(x) if len(x) else None for x in sets], pa.binary()),
                        "sketch": long_lists([none if x is None else odd_sketch(x) for x in least]),
                        "bands": long_lists([none if x is None else band_hashes(x) for x in least]),
                    }
                )

    return _keyed(docs).mapInArrow(run, SIGNED)


def clusters(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(node, cluster)``: nodes tied by shared bands, directly or over others."""
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = staged(
        banded.groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size"))
        .where("size > 1"),
        "buckets",
    )
    twos = buckets.where("size = 2").select("first", "last").distinct()
    sketches = nodes.select("node", "sketch")
    near = sum(
        (F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(1, SKETCH_BITS // 64)),
        F.bit_count(F.col("a.sketch")[0].bitwiseXOR(F.col("b.sketch")[0])),
    ) <= farthest(percent)
    close = (
        twos.join(sketches.alias("a"), F.col("first") == F.col("a.node"))
        .join(sketches.alias("b"), F.col("last") == F.col("b.node"))
        .where(near)
        .select("first", "last")
    )
    more = (
        banded.join(buckets.where("size > 2").select("key", "first"), "key")
        .where("node <> first")
        .select("first", F.col("node").alias("last"))
        .distinct()
    )
    return components(close.unionByName(more), "first", "last").withColumnRenamed("component", "cluster")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Block:
    """The nodes of one comparison, with groups that grow as links are found."""

    def __init__(self, table: pa.Table, percent: int):
        self.ids = table.column("node").to_numpy()
        self.sets = [np.asarray(x.values) for x in table.column("shingles")]
        self.size = np.array([len(x) for x in self.sets])
        sketches = np.array([np.asarray(x.values) for x in table.column("sketch")], np.int64)
        self.sketch = sketches.reshape(len(self.ids), -1).view(np.uint64)
        self.root = list(range(len(self.ids)))
        self.percent, self.limit = percent, farthest(percent)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if self.ids[a] > self.ids[b]:
            a, b = b, a
        self.root[b] = a

    def compare(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Links found between two lists of places, nearest sketches first; groups joined before are not compared."""
        far = np.zeros((len(left), len(right)), np.int32)
        for w in range(self.sketch.shape[1]):
            far += np.bitwise_count(self.sketch[left, w][:, None] ^ self.sketch[right, w][None, :])
        a, b = self.size[left][:, None], self.size[right][None, :]
        x, y = np.nonzero((far <= self.limit) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)))
        found = []
        for k in np.argsort(far[x, y], kind="stable"):
            i, j = int(left[x[k]]), int(right[y[k]])
            if self.find(i) != self.find(j) and _linked(self.sets[i], self.sets[j], self.percent):
                self.join(i, j)
                found.append((i, j))
        return found


def _inner(percent: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, percent)
        every = np.arange(len(block.ids))
        block.compare(every, every)
        label = [block.ids[block.find(i)] for i in every]
        return table.select(["node", "cluster", "pieces"]).append_column("label", pa.array(label, pa.int64()))

    return run


def _outer(percent: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, percent)
        known: dict[int, int] = {}
        for i, label in enumerate(table.column("label").to_pylist()):
            block.join(known.setdefault(label, i), i)
        odd = table.column("odd").to_numpy(zero_copy_only=False)
        found = block.compare(np.flatnonzero(odd), np.arange(len(odd)))
        return pa.table(
            {
                "u": pa.array([block.ids[i] for i, _ in found], pa.int64()),
                "v": pa.array([block.ids[j] for _, j in found], pa.int64()),
            }
        )

    return run


def _piece(count: str, salt: int) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))


def _with_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The shingle sets of nodes, from the texts; a text of the same id and key with another digest is not the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(row_shingles(batch.column("text"), n))
                own = [digest(x) == d for x, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
                kept = batch.drop_columns(["text", "digest"]).filter(pa.array(own))
                yield kept.append_column("shingles", long_lists([x for x, ok in zip(sets, own, strict=True) if ok]))

    rows = nodes.join(_keyed(docs), ["doc_id", "text_key"]).select("node", "cluster", "pieces", "digest", "sketch", "text")
    schema = "node long, cluster long, pieces long, sketch array<long>, shingles array<long>"
    return rows.mapInArrow(run, schema).dropDuplicates(["node"])


def _labels(docs: DataFrame, nodes: DataFrame, percent: int, n: int, block: int) -> DataFrame:
    """``(node, component)`` for nodes that are linked with a smaller one."""
    tied = clusters(nodes, percent)
    sizes = tied.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
    members = staged(_with_sets(docs, tied.join(sizes, "cluster").join(nodes, "node"), n), "sets")
    places = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(
        F.array(_piece("pieces", 1))
    )
    inner = staged(
        members.withColumn("piece", F.explode(places))
        .groupBy("cluster", "piece")
        .applyInArrow(_inner(percent), "node long, cluster long, pieces long, label long"),
        "inner",
    )
    small = inner.where("pieces = 1 AND node <> label").select("node", F.col("label").alias("component"))
    large = inner.where("pieces > 1")
    if large.isEmpty():
        return small
    first = large.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    so_far = components(first, "u", "v").withColumnRenamed("component", "label")
    labelled = staged(
        members.where("pieces > 1")
        .select("node", "cluster", "pieces")
        .join(so_far, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "labels",
    )
    groups = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = groups.groupBy("cluster").agg(
        F.max_by("label", "n").alias("main"),
        F.ceil((F.sum("n") - F.max("n")) / block).cast("long").alias("odd_pieces"),
    )
    zero = F.lit(0).cast("long")
    both = (
        members.where("pieces > 1")
        .join(labelled.select("node", "label"), "node")
        .join(main.where("odd_pieces > 0"), "cluster")
        .withColumn("odd", F.col("label") != F.col("main"))
    )
    # a node outside the main group meets every piece of its cluster, any node every piece of those outside
    odd = both.where("odd").withColumn("odd_piece", _piece("odd_pieces", 2))
    odd = odd.withColumn("piece", F.explode(F.sequence(zero, F.col("pieces") - 1)))
    rest = both.withColumn("odd", F.lit(False)).withColumn("piece", _piece("pieces", 1))
    rest = rest.withColumn("odd_piece", F.explode(F.sequence(zero, F.col("odd_pieces") - 1)))
    outer = (
        odd.unionByName(rest)
        .select("cluster", "piece", "odd_piece", "node", "label", "odd", "sketch", "shingles")
        .groupBy("cluster", "piece", "odd_piece")
        .applyInArrow(_outer(percent), "u long, v long")
    )
    whole = components(first.unionByName(outer), "u", "v").where("node <> component")
    return small.unionByName(whole)


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs (doc_id, text)``.

    Shingles are runs of ``n`` words, A-Z as a-z; a shorter text is one shingle,
    a null, empty or wordless text has none and is linked with nothing. Other
    columns are ignored. A repeated row gets the same answer each time. Rows that
    share an id but not a text are compared as texts of their own. A row without an
    id is in no component (null) and kept. An empty table gives an empty table.
    """
    rows = staged(signed(docs, n), "signed")
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    best = F.min_by(F.struct("text_key", "sketch", "bands"), "doc_id").alias("best")
    nodes = staged(
        named.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), best)
        .select("digest", F.monotonically_increasing_id().alias("node"), "doc_id", "best.text_key", "best.sketch", "best.bands"),
        "nodes",
    )
    labels = _labels(docs.where("doc_id IS NOT NULL"), nodes, percent, n, block)
    members = (
        nodes.select("digest", "node", "doc_id")
        .join(labels, "node", "left")
        .select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    )
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = members.join(least, "component").select("digest", "component_id")
    return (
        rows.join(classes, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))
    )
