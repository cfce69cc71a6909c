"""Streaming forms of the scanner and the monitor; they reuse the batch columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftworks.functions.rules import Rule
from siftworks.operators.events import MonitorOptions, plan_actions, select_events
from siftworks.operators.match import scan_text
from siftworks.session import staged
from siftworks.sources.journal import carry_out
from siftworks.sources.writers import run_actions
from siftworks.streaming.bursts import debounce_live, start_live

# later than any event
END = "9999-12-31 00:00:00"


def scan_stream(texts: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """Findings of arriving texts. Stateless: the same plan as a batch scan, applied to what is new."""
    if not texts.isStreaming:
        raise ValueError("scan_stream needs a streaming DataFrame; use scan_text for a batch")
    return scan_text(texts, rules, **options)


def stream_dedup(
    findings: DataFrame, keys: Sequence[str] = ("rule_name", "file", "matched_text"), *, ts: str = "ts", delay: str = "1 hour"
) -> DataFrame:
    """One finding per key; state for a key is dropped once the watermark passes it."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def debounce_stream(
    events: DataFrame, gap: str = "300 milliseconds", *, delay: str = "10 seconds", order: str = "seq"
) -> DataFrame:
    """Last event of every burst on a path, delivered when the watermark shows that the burst is over."""
    last = F.struct("kind", "kind_detail", F.col(order).alias("last_order"))
    bursts = (
        events.withWatermark("ts", delay)
        .groupBy("path", F.session_window("ts", gap).alias("burst"))
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count("*").alias("events"),
            F.max_by(last, F.struct("ts", order)).alias("_last"),
        )
    )
    return bursts.select(
        "path", "first_ts", "last_ts", "events", "_last.kind", "_last.kind_detail", "_last.last_order"
    )


def with_end(events: DataFrame, folder: str) -> DataFrame:
    """A bounded stream of events with one more event, on no path and later than all others.

    It moves the watermark past every open burst, so that ``debounce_stream`` delivers all
    of them before the stream ends.  The event is written to ``folder``, which must be new and shared.
    """
    spark = events.sparkSession
    last = {"ts": F.lit(END).cast(events.schema["ts"].dataType)}
    row = spark.range(1).select(*[last.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema.fields])
    row.write.parquet(folder)
    return events.unionByName(spark.readStream.schema(row.schema).parquet(folder))


def monitor(
    events: DataFrame,
    options: MonitorOptions,
    *,
    out: str,
    checkpoint: str,
    dry_run: bool = True,
    debounced: bool = False,
    live: bool = False,
    delay: str = "10 seconds",
    available_now: bool = False,
    journal: str | None = None,
) -> StreamingQuery:
    """Watch a stream of ``(ts, path, kind, kind_detail, seq)`` and act on what passes the filter.

    With ``debounced`` only the last event of a burst on a path is acted on, where
    ``options.debounce_ms`` is the pause that ends a burst and ``delay`` how late
    events may arrive.  With ``live`` bursts are ended by the clock instead, so that the
    last one on a quiet folder is acted on once the pause has gone by; such a query runs until it is stopped.

    Each micro-batch writes its report to its own folder ``out/batch=<id>``, so a
    batch that is run again after a failure replaces its report.  Its steps are carried out
    once all the same: ``journal`` (``out`` with ``.journal`` by default) holds what each batch set out to do.  A failing action
    is a row with an error (see ``failed_actions``) and does not stop the stream.
    """
    options.check()
    journal = journal or f"{out.rstrip('/')}.journal"
    if live and (available_now or not debounced):
        raise ValueError("live goes with debounced and runs until it is stopped")
    selected = select_events(events, options)
    if live:
        bursts = debounce_live(selected, f"{options.debounce_ms} milliseconds")
        selected = bursts.select(F.col("last_ts").alias("ts"), "path", "kind", "kind_detail", F.col("last_order").alias("seq"))
    elif debounced:
        bursts = debounce_stream(selected, f"{options.debounce_ms} milliseconds", delay=delay)
        selected = bursts.select(F.col("last_ts").alias("ts"), "path", "kind", "kind_detail", F.col("last_order").alias("seq"))

    def act(batch: DataFrame, batch_id: int) -> None:
        if live:
            # the plan below uses the batch twice, but its timers may run once only
            batch = staged(batch, "bursts")
            if batch.isEmpty():
                return
        ordered = batch.withColumn("ts_micros", F.unix_micros(F.col("ts").cast("timestamp")))
        plan = plan_actions(ordered, options.action, options.dest)
        folder = f"{out}/batch={batch_id}"
        if dry_run:
            run_actions(plan).write.mode("overwrite").parquet(folder)
        else:
            # the folder keeps the batch's intents beside its report, so a batch that is run again finishes what it began
            carry_out(plan, f"{journal}/batch={batch_id}").write.mode("overwrite").parquet(folder)

    writer = selected.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    if live:
        return start_live(writer.trigger(processingTime=f"{options.debounce_ms} milliseconds"), events.sparkSession)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def failed_actions(report: DataFrame) -> DataFrame:
    return report.filter(F.col("error").isNotNull())


def write_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there now into parquet files and wait for the end."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def event_source(spark, path: str, schema, *, fmt: str = "parquet", name_glob: str | None = None, **options: str) -> DataFrame:
    """Events arriving as files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.options(**options).load(path)


def arrivals(spark, root: str, *, recursive: bool = True) -> DataFrame:
    """Create events from files that appear below a folder, as a stream; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select(
        F.col("modificationTime").alias("ts"),
        "path",
        F.lit("create").alias("kind"),
        F.lit(None).cast("string").alias("kind_detail"),
        F.lit(0).cast("long").alias("seq"),
    )
