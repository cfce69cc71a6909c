"""Bursts of events ended by the clock: keyed state and processing-time timers.

``debounce_stream`` hands over a burst once the watermark passes it, so the last burst on a quiet folder waits for an
event that may never come. Here each path keeps its open burst in the state store and sets a timer; a
burst is delivered when a later event starts the next one, or when the timer runs out.
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

_BURST = "first_micros long, last_micros long, events long, kind string, kind_detail string, last_order long"
_OUT = f"path string, {_BURST}"

# Fixed names: the setting and the state store that timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(bursts: list[tuple], first: int, last: int, events: int, order: int, kind: str, detail: str | None, gap: int) -> None:
    """Put a burst among ``bursts``, which ascend and lie more than ``gap`` apart; it swallows those it touches.

    A burst is ``(first, last, events, kind, detail, order)``, the last three those of its last event.
    """
    at = bisect_right(bursts, first, key=lambda b: b[0])
    lo = at - 1 if at and bursts[at - 1][1] + gap >= first else at
    hi = at
    while hi < len(bursts) and bursts[hi][0] <= last + gap:
        hi += 1
    touched = [*bursts[lo:hi], (first, last, events, kind, detail, order)]
    end = max(touched, key=lambda b: (b[1], b[5] is not None, b[5] or 0))
    bursts[lo:hi] = [(min(b[0] for b in touched), end[1], sum(b[2] for b in touched), *end[3:])]


class Debouncer(StatefulProcessor):
    """One open burst and one timer for each path; memory follows the bursts of a batch, not its events."""

    def __init__(self, gap_micros: int, wait_ms: int):
        self.gap, self.wait = gap_micros, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"{_BURST}, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, bursts = self.open.get(), []
        if held:
            first, last, events, kind, detail, order, due = held
            bursts.append((first, last, events, kind, detail, order))
            self.handle.deleteTimer(due)
        for row in rows:
            joined(bursts, row.ts_micros, row.ts_micros, 1, row.last_order, row.kind, row.kind_detail, self.gap)
        for burst in bursts[:-1]:
            yield self._row(key, burst)
        first, last, events, kind, detail, order = bursts[-1]
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.open.update((first, last, events, kind, detail, order, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if held and held[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            first, last, events, kind, detail, order, _ = held
            yield self._row(key, (first, last, events, kind, detail, order))

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, burst) -> Row:
        first, last, events, kind, detail, order = burst
        return Row(
            path=key[0], first_micros=first, last_micros=last, events=events, kind=kind, kind_detail=detail, last_order=order
        )


def debounce_live(events: DataFrame, gap: str = "300 milliseconds", *, wait: str | None = None, order: str = "seq") -> DataFrame:
    """Last event of every burst on a path, delivered at the latest when ``wait`` (by default the gap) has gone by.

    Bursts are told apart by the events' own times, as in ``debounce``; the clock only decides when to stop
    waiting for more. An event that arrives after its burst was delivered is a burst of its own. Start the
    query with ``start_live``, as timers need a state store of another kind than Spark's default.
    """
    spark = events.sparkSession
    micros = {text: spark.sql(f"SELECT CAST(INTERVAL '{text}' AS INTERVAL DAY TO SECOND) AS i").first().i for text in {gap, wait or gap}}
    gap_micros, wait_ms = int(micros[gap].total_seconds() * 1_000_000), int(micros[wait or gap].total_seconds() * 1000)
    slim = events.select(
        "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"), "kind", "kind_detail",
        F.col(order).cast("long").alias("last_order"),
    )
    bursts = slim.groupBy("path").transformWithState(
        statefulProcessor=Debouncer(gap_micros, wait_ms), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime"
    )
    return bursts.select(
        "path",
        F.timestamp_micros("first_micros").alias("first_ts"),
        F.timestamp_micros("last_micros").alias("last_ts"),
        "events",
        "kind",
        "kind_detail",
        "last_order",
    )


def start_live(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query with timers; the session's own setting of the state store stays as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.outputMode("append").start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def stop_when_drained(query: StreamingQuery, seconds: float = 600) -> None:
    """Stop a query with timers once it has read something and no burst is open any more.

    Such a query never ends by itself: it goes on looking at the clock.
    """
    deadline, seen = time.monotonic() + seconds, False
    try:
        while time.monotonic() < deadline:
            if (error := query.exception()) is not None:
                raise error
            progress = query.lastProgress
            seen = seen or any(p.numInputRows for p in query.recentProgress)
            if seen and progress and not progress.numInputRows and all(not s.numRowsTotal for s in progress.stateOperators):
                return
            time.sleep(0.2)
        raise TimeoutError(f"bursts were still open after {seconds} seconds")
    finally:
        query.stop()
