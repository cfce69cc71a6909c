"""Walking file trees.

Spark's own file readers leave out names that begin with a dot or an underscore,
and ``.env`` files are what a scan is after.  So directories are listed level by
level as a distributed job that prunes ignored ones before going into them, and
contents are read in a second step, only for the files that are left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.session import staged

ENTRIES = "path string, is_dir boolean, length long, micros long"
PARTITION_BYTES = 128 << 20
BATCH_BYTES = 32 << 20
FRAME_ROWS = 10_000  # entries of a folder that are handed over at once


def open_filesystem(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def path_exists(path: str) -> bool:
    from pyarrow import fs

    filesystem, at = open_filesystem(path)
    return filesystem.get_file_info(at).type != fs.FileType.NotFound


def walk_tree(spark: SparkSession, root: str, keep: Column | None = None, *, recursive: bool = True) -> DataFrame:
    """Files below ``root`` as ``(root, path, length, modificationTime)``, paths relative to it.

    ``keep`` is a condition on ``path`` that also decides which directories are
    entered.  Symbolic links are not followed and unreadable directories are
    skipped.  One round per directory level; each level is listed in parallel and
    stored, so a lost executor repeats one level at most.  Of a local directory
    only the names are read by one task; its files are measured in parallel.
    """
    from pyarrow import fs

    keep = F.lit(True) if keep is None else keep
    tasks = spark.sparkContext.defaultParallelism
    local = isinstance(open_filesystem(root)[0], fs.LocalFileSystem)

    def list_directories(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_filesystem(root)
        base = base.rstrip("/")
        for frame in frames:
            for folder in frame["path"]:
                at = f"{base}/{folder}" if folder else base or "/"
                if local:
                    yield from list_names(folder, at)
                    continue
                try:
                    infos = filesystem.get_file_info(fs.FileSelector(at))
                except OSError:
                    continue
                infos = [i for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory)]
                for first in range(0, len(infos), FRAME_ROWS):
                    some = infos[first : first + FRAME_ROWS]
                    yield pd.DataFrame(
                        {
                            "path": [f"{folder}/{i.base_name}" if folder else i.base_name for i in some],
                            "is_dir": [i.type == fs.FileType.Directory for i in some],
                            "length": [i.size or 0 for i in some],
                            "micros": [(i.mtime_ns or 0) // 1000 for i in some],
                        }
                    )

    def list_names(folder: str, at: str) -> Iterator[pd.DataFrame]:
        try:
            with os.scandir(at) as found:
                # of these two kinds, links left out
                kinds = [(e.name, e.is_dir(follow_symlinks=False)) for e in found if _is_plain(e)]
        except OSError:
            return
        for first in range(0, len(kinds), FRAME_ROWS):
            some = kinds[first : first + FRAME_ROWS]
            paths = [f"{folder}/{name}" if folder else name for name, _ in some]
            yield pd.DataFrame({"path": paths, "is_dir": [is_dir for _, is_dir in some], "length": 0, "micros": 0})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = open_filesystem(root)[1].rstrip("/")
        for frame in frames:
            facts = [_length_and_micros(f"{base}/{path}") for path in frame["path"]]
            there = [f is not None for f in facts]
            lengths, micros = zip(*[f for f in facts if f], strict=True) if any(there) else ((), ())
            yield frame[there].assign(length=lengths, micros=micros)

    levels = []
    frontier = spark.range(1).select(F.lit("").alias("path"))
    while True:
        entries = staged(frontier.repartition(tasks, "path").mapInPandas(list_directories, ENTRIES).filter(keep), "walk")
        levels.append(entries.filter(~F.col("is_dir")))
        frontier = entries.filter("is_dir").select("path")
        if not recursive or frontier.isEmpty():
            break
    files = reduce(DataFrame.unionByName, levels)
    if local:
        files = staged(files.repartition(tasks, "path").mapInPandas(measure, ENTRIES), "measured")
    return files.select(
        F.lit(root).alias("root"), "path", "length", F.timestamp_micros("micros").alias("modificationTime")
    )


def _is_plain(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir(follow_symlinks=False) or entry.is_file(follow_symlinks=False)
    except OSError:
        return False


def _length_and_micros(path: str) -> tuple[int, int] | None:
    """Size and time of a local file; None if it has gone."""
    try:
        found = os.stat(path, follow_symlinks=False)
    except OSError:
        return None
    return found.st_size, found.st_mtime_ns // 1000


def with_content(files: DataFrame) -> DataFrame:
    """Read the listed files: adds ``content``; files that can no longer be read drop out.

    Files are spread by count over tasks of about 128 MB, and a task hands over
    its contents in small batches.
    """
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))
    names = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, paths = batch.column("root").to_pylist(), batch.column("path").to_pylist()
            rows, contents, held = [], [], 0

            def flush() -> pa.RecordBatch:
                picked = batch.select(names).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*picked.columns, pa.array(contents, pa.binary())], names=[*names, "content"])

            for row, (root, path) in enumerate(zip(roots, paths, strict=True)):
                filesystem, base = open_filesystem(root)
                try:
                    with filesystem.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    continue
                rows.append(row)
                contents.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, contents, held = [], [], 0
            yield flush()

    return files.repartition(tasks, "path").mapInArrow(read, schema)
