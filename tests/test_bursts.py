from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftworks.operators import events as E
from siftworks.streaming import bursts, streams

SCHEMA = "seq long, ts_micros long, path string, kind string, kind_detail string"
SECOND = 1_000_000


def write(frame, rows, folder):
    log = frame(rows, SCHEMA).select("seq", F.timestamp_micros("ts_micros").alias("ts"), "path", "kind", "kind_detail")
    log.coalesce(1).write.mode("append").parquet(folder)
    return log.schema


def live(spark, folder, schema, gap, wait, at):
    source = streams.event_source(spark, folder, schema, maxFilesPerTrigger="1")
    found = bursts.debounce_live(source, gap, wait=wait)
    writer = found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check")
    return bursts.start_live(writer, spark), found.schema


def results(spark, schema, at):
    rows = spark.read.schema(schema).parquet(f"{at}/out")
    return sorted(map(tuple, rows.select("path", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "events", "kind", "kind_detail", "last_order").collect()))


def until(condition, seconds=90):
    deadline = time.monotonic() + seconds
    while not condition() and time.monotonic() < deadline:
        time.sleep(0.2)
    assert condition()


def test_all_bursts_come_without_a_later_event(spark, frame, tmp_path):
    """Shuffled events of one batch give the bursts of the batch form, the last one of every path included."""
    rng = random.Random(7)
    rows = [(i, rng.randrange(0, 400) * SECOND, rng.choice("aabc"), rng.choice(("create", "modify")), rng.choice((None, "data"))) for i in range(200)]
    schema = write(frame, rows, str(tmp_path / "in"))
    query, out = live(spark, str(tmp_path / "in"), schema, "5 seconds", "1 second", tmp_path)
    bursts.stop_when_drained(query, 120)
    wanted = sorted(map(tuple, E.debounce(frame(rows, SCHEMA), 5 * SECOND).collect()))
    assert results(spark, out, tmp_path) == wanted
    assert spark.conf.get(bursts.PROVIDER, None) != bursts.ROCKSDB


def test_open_bursts_survive_a_restart(spark, frame, tmp_path):
    """A query stopped with a burst open goes on with it: an event joins, and then it is delivered."""
    schema = write(frame, [(1, 10 * SECOND, "a", "create", None), (2, 50 * SECOND, "b", "create", None)], str(tmp_path / "in"))
    query, out = live(spark, str(tmp_path / "in"), schema, "5 seconds", "1 hour", tmp_path)
    until(lambda: any(p.numInputRows for p in query.recentProgress))
    query.stop()
    assert results(spark, out, tmp_path) == []
    write(frame, [(3, 12 * SECOND, "a", "modify", "data"), (4, 90 * SECOND, "b", "remove", None)], str(tmp_path / "in"))
    query, out = live(spark, str(tmp_path / "in"), schema, "5 seconds", "1 second", tmp_path)
    until(lambda: len(results(spark, out, tmp_path)) == 3)
    query.stop()
    assert results(spark, out, tmp_path) == [
        ("a", 10 * SECOND, 12 * SECOND, 2, "modify", "data", 3),
        ("b", 50 * SECOND, 50 * SECOND, 1, "create", None, 2),
        ("b", 90 * SECOND, 90 * SECOND, 1, "remove", None, 4),
    ]


def test_joined_against_sorting():
    rng = random.Random(3)
    for _ in range(200):
        gap, times = rng.randrange(0, 6), [rng.randrange(0, 60) for _ in range(rng.randrange(1, 25))]
        found = []
        for i, t in enumerate(times):
            bursts.joined(found, t, t, 1, i, f"k{i}", None, gap)
        wanted, ordered = [], sorted((t, i) for i, t in enumerate(times))
        for t, i in ordered:
            if wanted and t - wanted[-1][-1][0] <= gap:
                wanted[-1].append((t, i))
            else:
                wanted.append([(t, i)])
        assert found == [(g[0][0], g[-1][0], len(g), f"k{g[-1][1]}", None, g[-1][1]) for g in wanted]


def test_joined_takes_events_without_an_order():
    found = []
    bursts.joined(found, 1, 1, 1, None, "create", None, 5)
    bursts.joined(found, 1, 1, 1, 4, "modify", None, 5)
    bursts.joined(found, 1, 1, 1, None, "remove", None, 5)
    assert found == [(1, 1, 3, "modify", None, 4)]


def test_monitor_acts_on_the_last_burst_of_a_quiet_folder(spark, frame, tmp_path):
    inbox, copies = tmp_path / "inbox", tmp_path / "copies"
    inbox.mkdir()
    for name in ("a", "b"):
        (inbox / name).write_text(name)
    rows = [(i, (1000 + i // 10) * SECOND // 10, str(inbox / p), "modify", "data") for i, p in enumerate(["a"] * 5 + ["b"] * 3)]
    schema = write(frame, rows, str(tmp_path / "log"))
    source = streams.event_source(spark, str(tmp_path / "log"), schema)
    options = E.MonitorOptions((str(inbox),), "copy", str(copies), on_modify=True, debounce_ms=500)
    with pytest.raises(ValueError):
        streams.monitor(source, options, out="o", checkpoint="c", debounced=True, live=True, available_now=True)
    query = streams.monitor(source, options, out=str(tmp_path / "report"), checkpoint=str(tmp_path / "check"), dry_run=False, debounced=True, live=True)
    try:
        until(lambda: copies.exists() and {p.name for p in copies.iterdir()} == {"a", "b"})
    finally:
        bursts.stop_when_drained(query, 60)
    steps = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "report")).collect():
        steps[r.source.rsplit("/", 1)[1]].append(r.done)
    assert steps == {"a": [True], "b": [True]}
