"""Edits and runs applied to blobs that are held as chunks ``(path, chunk_no, start, content)``.

Runs meet the chunks that they touch through an equal key, the path and the number of a stretch of bytes, and are cut at
its ends. So the edits of one blob spread over as many tasks as it has chunks, a chunk that no run touches is passed
on as it is, and what comes together in one row is bounded by the chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.operators.edits import apply_runs
from siftworks.sources.trees import open_filesystem

PATCH_BYTES = 1 << 20


def runs_in_chunks(edits: DataFrame, chunk: int = PATCH_BYTES) -> DataFrame:
    """Single-byte edits, one for each (path, offset), as runs ``(path, chunk_no, start, bytes)`` that end at chunk borders."""
    dealt = edits.withColumn("chunk_no", F.floor(F.col("offset") / chunk))
    position = F.row_number().over(Window.partitionBy("path", "chunk_no").orderBy("offset"))
    digits = F.lpad(F.hex(F.col("byte").cast("long")), 2, "0")
    runs = dealt.withColumn("_island", F.col("offset") - position).groupBy("path", "chunk_no", "_island")
    cells = F.array_sort(F.collect_list(F.struct("offset", digits.alias("digits"))))
    told = runs.agg(F.min("offset").alias("start"), F.unhex(F.array_join(F.transform(cells, lambda c: c["digits"]), "")).alias("bytes"))
    return told.select("path", "chunk_no", "start", "bytes")


def cut_runs(runs: DataFrame, chunk: int = PATCH_BYTES) -> DataFrame:
    """Runs ``(path, start, bytes)`` of any length cut at chunk borders; they must not overlap."""
    end = F.col("start") + F.octet_length("bytes")
    numbers = F.sequence(F.floor(F.col("start") / chunk), F.floor((end - 1) / chunk))
    rows = runs.where((F.col("start") >= 0) & (F.octet_length("bytes") > 0)).select("*", F.explode(numbers).alias("chunk_no"))
    first = F.greatest(F.col("start"), F.col("chunk_no") * chunk)
    size = F.least(end, (F.col("chunk_no") + 1) * chunk) - first
    piece = F.substring("bytes", (first - F.col("start") + 1).cast("int"), size.cast("int"))
    return rows.select("path", "chunk_no", first.alias("start"), piece.alias("bytes"))


def patch_chunks(chunks: DataFrame, pieces: DataFrame, chunk: int = PATCH_BYTES) -> DataFrame:
    """Chunks of ``chunk`` bytes with the pieces ``(path, chunk_no, start, bytes)`` written over them.

    What lies beyond the end of a blob is left out, as in ``apply_runs``.
    """
    # every chunk is a blob of its own
    key = F.struct("path", "chunk_no").alias("path")
    own = pieces.select(key, (F.col("start") - F.col("chunk_no") * chunk).alias("start"), "bytes")
    patched = apply_runs(chunks.select(key, "start", "content"), own)
    return patched.select("path.path", "path.chunk_no", "start", "content")


def write_chunks(chunks: DataFrame, root: str) -> DataFrame:
    """Write chunks as the files that they make up, and give ``(path, length)`` of each file.

    A file is written front to back by one task, chunk by chunk, under a temporary name and then renamed, so a
    repeated task leaves no partial file. Paths must be reachable from every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_filesystem(root)
        name = partial = out = None
        length = 0

        def closed() -> pa.RecordBatch:
            out.close()
            filesystem.move(partial, f"{base.rstrip('/')}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([length], pa.int64())], names=["path", "length"])

        try:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    if path != name:
                        if out:
                            yield closed()
                        name, length, place = path, 0, f"{base.rstrip('/')}/{path}"
                        filesystem.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        partial = f"{place}.{uuid.uuid4().hex}.part"
                        out = filesystem.open_output_stream(partial)
                    out.write(content.as_buffer())
                    length += len(content.as_buffer())
            if out:
                yield closed()
                out = None
        finally:
            if out and not out.closed:
                out.close()
                filesystem.delete_file(partial)

    dealt = chunks.select("path", "chunk_no", "content").repartition("path").sortWithinPartitions("path", "chunk_no")
    return dealt.select("path", "content").mapInArrow(run, "path string, length long")
