"""Quality classifier: logistic regression on hashed token n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters, of digits, of other visible bytes, and of white space
beyond one character; A-Z stay apart from a-z. A text's features are its token
counts and counts of token pairs, hashed into ``2**BITS`` buckets and divided by
their number, so its score is a sparse dot product. An n-gram that says more by its form than by
its words is counted under the form as well: a token after itself, after itself and
one other, and runs of five tokens that the text has had before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.llm.words import hashed_runs, mixed, ngram_hashes, slices, text_bytes

BITS = 18
SAMPLE_ROWS = 6000
EPOCHS = 3
# learning rate, its offset, and the two penalties
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-6, 1e-6
SCALE = 20.0
# buckets of the constant feature and of the forms
CONSTANT, TWICE, ALTERNATING, REPEATED = 0, 1, 2, 3


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(256, 3, np.uint8)
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    kind[0x30:0x3A] = 2
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return kind, mixed(np.arange(1, 257, dtype=np.uint64)), kind != 0


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of a column, and the border of each row in them.

    Every text has the constant feature, the empty one too.
    """
    kind, value, inside = _kinds()
    raw, rows = text_bytes(column)
    tokens, start, _ = hashed_runs(raw, rows, kind, value, inside)
    borders = np.searchsorted(start, rows)
    found, sizes = [], []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        own = tokens[a:b]
        pairs = mixed(own[:-1] * np.uint64(3) + own[1:])
        hashed = np.concatenate([own, pairs]) & np.uint64((1 << bits) - 1)
        again = max(0, len(own) - 4) - len(np.unique(ngram_hashes(own, 5))) if len(own) > 4 else 0
        forms = [1, int((own[1:] == own[:-1]).sum()), int((own[2:] == own[:-2]).sum()), again]
        row = np.concatenate([np.repeat([CONSTANT, TWICE, ALTERNATING, REPEATED], forms), hashed.astype(np.int64)])
        found.append(row)
        sizes.append(len(row))
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS
) -> np.ndarray:
    """FTRL-proximal over sparse rows ``(buckets, values)``; the weights."""
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    positive = max(1.0, float(labels.sum()))
    balance = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1.0, len(labels) - positive)))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(np.dot(w[at], x), -30, 30)))
            g = (p - labels[i]) * x * balance[i]
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w[at]
            n[at] = squared
            rate = (BETA + np.sqrt(squared)) / ALPHA + L2
            w[at] = np.where(np.abs(z[at]) <= L1, 0, (np.sign(z[at]) * L1 - z[at]) / rate)
    return w


def learning_rows(doc_id: str = "doc_id") -> Column:
    """Whether labels of a row may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``rows`` labelled learning rows, those with the smallest hash of their id; conflicting labels drop out."""
    marks = (
        labels.where(learning_rows())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other AND doc_id IS NOT NULL")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(marks), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learnt in one task from a sample of at most ``rows`` labelled rows; zeros if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for whole in batches:
            for batch in slices(whole, "text"):
                buckets, borders = features(batch.column("text"), bits)
                ids, marks = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
                for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                    at, count = np.unique(buckets[a:b], return_counts=True)
                    data.append((ids[k], at, count * (SCALE / (b - a)), marks[k]))
        data.sort(key=lambda x: x[0])
        w = train([x[1:3] for x in data], np.array([x[3] for x in data], np.float64), bits)
        at = np.flatnonzero(w)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    sample = labelled_sample(docs, labels, label, rows).repartition(1)
    learnt = sample.select("doc_id", "label", "text").mapInArrow(run, "bucket long, weight double").toPandas()
    weights = np.zeros(1 << bits)
    weights[learnt["bucket"].to_numpy()] = learnt["weight"].to_numpy()
    return weights


def _scores(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    buckets, borders = features(column, bits)
    sizes = np.diff(borders)
    total = np.add.reduceat(weights[buckets], borders[:-1]) if len(sizes) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(total * SCALE / np.maximum(sizes, 1), -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row's whole text, ``score`` from 0 to 1.

    A null text is the empty text, which is scored by the constant feature. Repeated rows
    get one score; a null id is not held out. Other columns are ignored; an empty table gives an
    empty table.
    """
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = _scores(batch.column("text"), shared.value, bits)
                yield batch.drop_columns(["text"]).append_column("score", pa.array(p, pa.float64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(~learning_rows(), F.lit(False))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns as they are."""
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(_scores(batch.column("text"), shared.value, bits) >= least))

    return docs.mapInArrow(run, docs.schema)
