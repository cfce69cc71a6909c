"""What a stream has to remember for good, as a table in hash buckets beside it.

A state store forgets keys when the watermark passes them, or grows in the memory and checkpoints of the query. A
ledger is a table in a shared folder, ``batches/batch=N/bucket=B``: a micro-batch reads what earlier batches
wrote, and only in the buckets that its own keys fall into. What a batch writes is known by its number, so a batch that
is run again after a failure does not see its own earlier attempt and replaces it. Every ``merge_every`` batches the
rows are merged into one generation, ``merged/upto=N/bucket=B``, which keeps the latest row of every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftworks.functions.text import split_lines
from siftworks.operators.delta import added_lines, line_hashes, with_text
from siftworks.plans.scans import ScanOptions, delta_wanted, scan_added
from siftworks.session import staged
from siftworks.sources.trees import open_filesystem

BUCKETS = 64
MERGE_EVERY = 32


def key_digest(*columns: str) -> Column:
    """SHA-256 of the columns' values, each with its length; null is a value of its own."""
    told = [F.coalesce(F.concat(F.length(text := F.col(c).cast("string")).cast("string"), F.lit(":"), text), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*told), 256))


class BatchLedger:
    """Rows ``(key, <columns>)`` by batch and bucket. ``columns`` is DDL, empty for a plain set of keys."""

    def __init__(
        self, spark: SparkSession, folder: str, columns: str = "", *, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY
    ):
        self.spark, self.folder, self.buckets, self.merge_every = spark, folder.rstrip("/"), buckets, merge_every
        self.schema = T.StructType.fromDDL("key binary" + (f", {columns}" if columns else ""))

    def bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, number: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(number, T.LongType()), T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _merged(self, batch_id: int) -> int:
        """The last batch of the newest complete generation of batches before this one, -1 without one."""
        from pyarrow import fs

        filesystem, base = open_filesystem(self.folder)
        found = filesystem.get_file_info(fs.FileSelector(f"{base}/merged", allow_not_found=True))
        numbers = sorted((int(info.base_name.removeprefix("upto=")) for info in found if info.base_name.startswith("upto=")), reverse=True)
        whole = (n for n in numbers if filesystem.get_file_info(f"{base}/merged/upto={n}/_SUCCESS").type == fs.FileType.File)
        return next((n for n in whole if n < batch_id), -1)

    def before(self, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """``(key, <columns>, batch, bucket)`` of all batches before this one; a key may have several rows."""
        upto = self._merged(batch_id)
        later = self._read("batches", "batch").where((F.col("batch") > upto) & (F.col("batch") < batch_id))
        rows = later
        if upto >= 0:
            merged = self._read("merged", "upto").where(F.col("upto") == upto)
            rows = merged.withColumnRenamed("upto", "batch").unionByName(later)
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.schema.fields if f.name != "key"]
        if not names:
            return rows.select("bucket", "key").distinct()
        newest = rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*names), "batch").alias("_row"))
        return newest.select("bucket", "key", *[F.col(f"_row.{n}").alias(n) for n in names])

    def latest(self, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """One row ``(bucket, key, <columns>)`` for every key known before this batch, that of the last batch that wrote it."""
        return self._latest(self.before(batch_id, buckets))

    def put(self, batch_id: int, rows: DataFrame) -> None:
        """Write this batch's rows ``(key, <columns>)``; merge first if many batches have piled up."""
        upto = self._merged(batch_id)
        if batch_id - 1 - upto >= self.merge_every:
            self._write(self.latest(batch_id), f"merged/upto={batch_id - 1}")
        self._write(rows.withColumn("bucket", self.bucket()), f"batches/batch={batch_id}")

    def _write(self, rows: DataFrame, part: str) -> None:
        # one file for a bucket unless a bucket is large
        dealt = rows.select(*self.schema.names, "bucket").repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{part}")


def _buckets_of(rows: DataFrame) -> list[int]:
    """The buckets in use, at most ``BatchLedger.buckets`` numbers."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def first_findings(batch: DataFrame, keys: Sequence[str], ledger: BatchLedger, batch_id: int) -> DataFrame:
    """Rows of a batch whose key no earlier batch had, one for each key: the least by all its columns."""
    names = batch.columns
    digested = batch.withColumn("_key", key_digest(*keys))
    first = digested.groupBy("_key").agg(F.min(F.struct(*names)).alias("_row"))
    found = staged(first.select(F.col("_key").alias("key"), ledger.bucket("_key").alias("bucket"), "_row"), "first")
    known = ledger.before(batch_id, _buckets_of(found)).select("key", "bucket")
    # the few keys of the batch look into the ledger, and only those found there come back
    seen = known.join(found.select("key", "bucket"), ["key", "bucket"], "left_semi").select("key")
    return found.join(seen, "key", "left_anti").select("key", "_row.*")


def dedup_with_ledger(
    findings: DataFrame,
    keys: Sequence[str] = ("rule_name", "file", "matched_text"),
    *,
    ledger: str,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """One finding per key for good, however late or far apart: the rows of ``DISTINCT`` over the whole stream.

    Each micro-batch writes its new findings to ``out/batch=<id>``, then their keys to the ledger. ``options``
    are those of ``BatchLedger``.
    """
    if not findings.isStreaming:
        raise ValueError("dedup_with_ledger needs a streaming DataFrame; use dropDuplicates for a batch")
    spark = findings.sparkSession

    def act(batch: DataFrame, batch_id: int) -> None:
        kept = BatchLedger(spark, ledger, **options)
        folder = f"{out}/batch={batch_id}"
        fresh = first_findings(batch, keys, kept, batch_id)
        # the key stays beside its finding until it is in the ledger
        fresh.withColumnRenamed("key", "_key").write.mode("overwrite").parquet(folder)
        kept.put(batch_id, spark.read.parquet(folder).select(F.col("_key").alias("key")))

    return _started(findings, act, checkpoint, available_now)


def _started(stream: DataFrame, act, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All that the batches of a stream have written, without helper columns."""
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def read_findings(spark: SparkSession, out: str, options: ScanOptions) -> DataFrame:
    """What ``scan_version_stream`` has written, with the ``version`` of each finding."""
    empty = spark.createDataFrame([], "path string, version long, line_no int, line string")
    return read_batches(spark, out, scan_added(empty, options, "version").schema)


_HASHES = "version long, hashes array<long>"


def new_version_lines(batch: DataFrame, state: BatchLedger, batch_id: int, *, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(<key>, version, line_no)`` of lines new against the version before, and the state that the batch leaves.

    ``batch(<key>, version, text)``. Versions of one key within a batch follow each other; the first of them is
    compared with the last one that earlier batches brought, and is new as a whole if there is none.
    """
    own = batch.select(key, F.col("version").cast("long").alias("version"), line_hashes(F.col("text")).alias("_has"))
    own = staged(own.withColumn("key", key_digest(key)).withColumn("bucket", state.bucket()), "versions")
    # only numbers are put in order; the hashes of two versions meet by an equal key
    before = F.lag("version").over(Window.partitionBy(key).orderBy("version"))
    steps = own.select(key, "version").distinct().withColumn("_before", before)
    earlier = own.select(F.col(key).alias("_of"), F.col("version").alias("_of_version"), F.col("_has").alias("_own_had"))
    known = state.latest(batch_id, _buckets_of(own)).select("key", F.col("hashes").alias("_known"))
    pairs = own.join(steps, [key, "version"])
    pairs = pairs.join(earlier, (F.col(key) == F.col("_of")) & (F.col("_before") == F.col("_of_version")), "left")
    pairs = pairs.join(known, "key", "left")
    had = F.when(F.col("_before").isNull(), F.col("_known")).otherwise(F.col("_own_had"))
    pairs = pairs.select(key, "version", had.alias("_had"), "_has").where(~F.col("_has").eqNullSafe(F.col("_had")))
    last = own.groupBy("key").agg(F.max("version").alias("version"), F.max_by("_has", "version").alias("hashes"))
    return added_lines(pairs, [key, "version"]), last


def scan_version_stream(
    versions: DataFrame, options: ScanOptions, *, state: str, out: str, checkpoint: str, available_now: bool = False, **settings
) -> StreamingQuery:
    """Findings on the new lines of every arriving version ``(path, version, text)`` of a file.

    The state holds the line hashes of each path's last version, so a version that arrives days later, or after
    a restart, is compared with it: two versions in two batches give what ``scan_delta`` gives. A micro-batch
    writes its findings to ``out/batch=<id>``, then the state. A version of a path comes once.
    """
    if not versions.isStreaming:
        raise ValueError("scan_version_stream needs a streaming DataFrame; use scan_delta for a batch")
    spark = versions.sparkSession

    def act(batch: DataFrame, batch_id: int) -> None:
        kept = BatchLedger(spark, state, _HASHES, **settings)
        texts = batch.where(delta_wanted(options)).select("path", F.col("version").cast("long").alias("version"), "text")
        lines, last = new_version_lines(texts, kept, batch_id)
        found = scan_added(with_text(texts, lines, ["path", "version"]), options, "version")
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept.put(batch_id, last)

    return _started(versions, act, checkpoint, available_now)
