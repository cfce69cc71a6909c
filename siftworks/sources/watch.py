"""A watched set of files and folders as a stream of events.

Batch jobs take inventories of what is watched. Each one is a numbered version in a shared folder: what was there,
and the events that lead to it from the version before. A marker file commits a version after both are written, so an
inventory whose job died is simply taken again under the same number. Contents are read for digests only where
length or time changed since the version before.

``InventoryEvents`` is a streaming source whose offsets are committed versions. Its partitions are the row groups of
the versions' event files, so events are read by the executors; the driver only lists markers and files. A
query that starts again from its checkpoint goes on behind the last version it has dealt with.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftworks.operators.events import manifest_diff
from siftworks.session import staged
from siftworks.sources.trees import open_filesystem, walk_tree

EVENTS = "ts timestamp, path string, kind string, kind_detail string, from_path string, seq long, version long"
_INVENTORY = "key string, at string, length long, modified timestamp, sha256 string"
SOURCE = "inventory_events"
DIGEST_BYTES = 1 << 30


def committed_versions(store: str) -> list[int]:
    """Versions of a store that are complete, ascending."""
    from pyarrow import fs

    filesystem, base = open_filesystem(store)
    found = filesystem.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/committed", allow_not_found=True))
    return sorted(int(info.base_name) for info in found if info.base_name.isdigit())


def _folder(store: str, version: int) -> str:
    return f"{store.rstrip('/')}/v{version:012d}"


def read_inventory(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(_INVENTORY).parquet(f"{_folder(store, version)}/inventory")


def _listed(spark: SparkSession, targets: Sequence[str], keep: Column | None, recursive: bool) -> DataFrame:
    """``(key, at, length, modified)`` of all files; with one folder as target, keys are relative to it."""
    from pyarrow import fs

    parts, files = [], []
    for target in targets:
        filesystem, path = open_filesystem(target)
        info = filesystem.get_file_info(path)
        if info.type == fs.FileType.File:
            files.append((target, target, info.size or 0, (info.mtime_ns or 0) // 1000))
        elif info.type == fs.FileType.Directory:
            root = target.rstrip("/")
            at = F.concat(F.lit(f"{root}/"), F.col("path"))
            key = F.col("path") if len(targets) == 1 else at
            walked = walk_tree(spark, root, keep, recursive=recursive)
            parts.append(walked.select(key.alias("key"), at.alias("at"), "length", F.col("modificationTime").alias("modified")))
    schema = "key string, at string, length long, micros long"
    single = spark.createDataFrame(files, schema)
    parts.append(single.select("key", "at", "length", F.timestamp_micros("micros").alias("modified")))
    # a file below two targets is one file
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["key"])


def _digested(files: DataFrame) -> DataFrame:
    """Add ``sha256``, read in blocks; files that can no longer be read drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("at").to_pylist():
                filesystem, at = open_filesystem(path)
                digest = hashlib.sha256()
                try:
                    with filesystem.open_input_stream(at) as stream:
                        while block := stream.read(1 << 20):
                            digest.update(block)
                except OSError:
                    digests.append(None)
                else:
                    digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"])

    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // DIGEST_BYTES))
    return files.repartition(tasks, "key").mapInArrow(run, _INVENTORY).where("sha256 IS NOT NULL")


def take_inventory(
    spark: SparkSession, targets: Sequence[str], store: str, *, keep: Column | None = None, recursive: bool = True
) -> int:
    """Write the next version of what is at ``targets``, files or folders, and give its number.

    The first one is the ground that later events start from and holds none itself, as a watcher does not
    report what was there before it. ``keep`` is a condition on the path below a target that also decides
    which folders are entered. One inventory of a store is taken at a time.
    """
    known = committed_versions(store)
    version = known[-1] + 1 if known else 0
    folder = _folder(store, version)
    listed = staged(_listed(spark, targets, keep, recursive), "listing")
    if known:
        before = read_inventory(spark, store, known[-1])
        same = before.select("key", "length", "modified", "sha256")
        joined = listed.join(same, ["key", "length", "modified"], "left")
        unread = joined.where("sha256 IS NULL").select("key", "at", "length", "modified")
        now = joined.where("sha256 IS NOT NULL").select("key", "at", "length", "modified", "sha256").unionByName(_digested(unread))
    else:
        now = _digested(listed)
    now.write.mode("overwrite").parquet(f"{folder}/inventory")
    now = read_inventory(spark, store, version)
    if known:
        sides = [x.select(F.col("key").alias("path"), "length", "modified", "sha256") for x in (before, now)]
        changes = manifest_diff(*sides)
        places = before.select("key", "at").unionByName(now.select("key", "at")).dropDuplicates(["key"])
        ends = places.select(F.col("key").alias("path"), F.col("at").alias("_at"))
        starts = places.select(F.col("key").alias("from_path"), F.col("at").alias("_from"))
        # only renames have a former path; all others would meet under the null key
        found = staged(changes.join(ends, "path"), "changes")
        renamed = found.where("from_path IS NOT NULL").join(starts, "from_path")
        others = found.where("from_path IS NULL").withColumn("_from", F.lit(None).cast("string"))
        found = others.unionByName(renamed)
        # one event for a path in a version; the number orders events of one version alike in every run
        seq = F.lit(version << 31) + F.pmod(F.xxhash64("path"), F.lit(1 << 31))
        events = found.select(F.col("_at").alias("path"), "kind", "kind_detail", F.col("_from").alias("from_path"), seq.alias("seq"))
    else:
        events = spark.createDataFrame([], "path string, kind string, kind_detail string, from_path string, seq long")
    events.withColumn("ts_micros", F.unix_micros(F.current_timestamp())).write.mode("overwrite").parquet(f"{folder}/events")
    filesystem, base = open_filesystem(store)
    filesystem.create_dir(f"{base.rstrip('/')}/committed", recursive=True)
    with filesystem.open_output_stream(f"{base.rstrip('/')}/committed/{version:012d}"):
        pass
    return version


class EventFile(InputPartition):
    """One row group of an event file."""

    def __init__(self, path: str, row_group: int, version: int):
        super().__init__(path)
        self.path, self.row_group, self.version = path, row_group, version


class InventoryReader(DataSourceStreamReader):
    """Events of committed versions; an offset is the last version that was read."""

    def __init__(self, store: str, start: str):
        self.store, self.start = store, start

    def initialOffset(self) -> dict:
        known = committed_versions(self.store)
        return {"version": known[-1] if known and self.start == "newest" else -1}

    def latestOffset(self) -> dict:
        return {"version": (committed_versions(self.store) or [-1])[-1]}

    def partitions(self, start: dict, end: dict) -> list[EventFile]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        filesystem, base = open_filesystem(self.store)
        found = []
        for version in committed_versions(self.store):
            if start["version"] < version <= end["version"]:
                for info in filesystem.get_file_info(fs.FileSelector(f"{_folder(base, version)}/events")):
                    if info.base_name.endswith(".parquet"):
                        with filesystem.open_input_file(info.path) as file:
                            groups = pq.ParquetFile(file).num_row_groups
                        found += [EventFile(info.path, group, version) for group in range(groups)]
        return found

    def read(self, partition: EventFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        filesystem, _ = open_filesystem(self.store)
        with filesystem.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(row_groups=[partition.row_group]):
                columns = {name: batch.column(name) for name in ("path", "kind", "kind_detail", "from_path", "seq")}
                ts = batch.column("ts_micros").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
                version = pa.array([partition.version] * batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ts, *columns.values(), version], names=["ts", *columns, "version"])


class InventoryEvents(DataSource):
    """``spark.readStream.format("inventory_events").option("store", ...)``; ``start`` is ``first`` or ``newest``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> InventoryReader:
        start = self.options.get("start", "first")
        if start not in ("first", "newest"):
            raise ValueError("start must be first or newest")
        if "store" not in self.options:
            raise ValueError("name the folder of inventories with the option store")
        return InventoryReader(self.options["store"], start)


def watch_events(spark: SparkSession, store: str, *, start: str = "first") -> DataFrame:
    """Create, modify, remove and rename events as a stream ``(ts, path, kind, kind_detail, from_path, seq, version)``.

    ``ts`` is the time at which the inventory saw the change. A rename is one event on the new path. A stream
    that has no checkpoint yet begins with the first version, or behind the ``newest`` one.
    """
    spark.dataSource.register(InventoryEvents)
    return spark.readStream.format(SOURCE).option("store", store).option("start", start).load()


class FolderWatch:
    """Takes inventories every so many seconds until it is stopped; use it as a context manager around a stream."""

    def __init__(self, spark: SparkSession, targets: Sequence[str], store: str, *, every: float = 1.0, **options):
        self.error: BaseException | None = None
        self._stop = threading.Event()
        if not committed_versions(store):
            take_inventory(spark, targets, store, **options)

        def run() -> None:
            try:
                while not self._stop.wait(every):
                    take_inventory(spark, targets, store, **options)
            except BaseException as error:  # noqa: BLE001 - raised where the watch is stopped
                self.error = error

        self._thread = threading.Thread(target=run, daemon=True)

    def __enter__(self) -> FolderWatch:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        if self.error:
            raise self.error
