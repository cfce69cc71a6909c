"""Event filters, debouncing, plans, inventories, actions and streams."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftworks.functions.rules import default_rules
from siftworks.functions.times import micros
from siftworks.operators import events as E
from siftworks.operators.match import scan_text
from siftworks.sources import writers
from siftworks.streaming import streams

SCHEMA = "seq long, ts_micros long, path string, kind string, kind_detail string"


def test_filters(frame):
    kinds = [("create", None), ("modify", "data"), ("modify", "name_any"), ("modify", "name_other"), ("remove", None),
             ("access", None), ("other", None), ("modify", None)]
    df = frame([(i, 0, "p", *k) for i, k in enumerate(kinds)], SCHEMA)

    def kept(condition):
        return {r.seq for r in df.filter(condition).collect()}

    everything = dict(on_create=True, on_modify=True, on_rename=True, on_delete=True)
    assert kept(E.event_filter(**everything)) == {0, 1, 2, 3, 4, 7}
    assert kept(E.event_filter(on_modify=True)) == {1, 3, 7}
    assert kept(E.event_filter(on_rename=True)) == {2}
    assert kept(E.event_filter()) == set()
    assert kept(E.event_filter_coarse(on_modify=True)) == {1, 2, 3, 7}
    assert kept(E.event_filter_coarse(on_rename=True)) == set()
    assert kept(E.event_filter_coarse(on_create=True, on_delete=True)) == {0, 4}


def test_options():
    good = E.MonitorOptions(("t",), "delete", on_delete=True)
    assert good.check() is good
    assert E.MonitorOptions(("t",), "copy", "/out", on_create=True).check()
    for bad in (
        E.MonitorOptions((), "delete", on_delete=True),
        E.MonitorOptions(("t",), "delete"),
        E.MonitorOptions(("t",), "copy", on_create=True),
        E.MonitorOptions(("t",), "move", on_create=True),
        E.MonitorOptions(("t",), "shred", on_create=True),
    ):
        with pytest.raises(ValueError):
            bad.check()


def bursts(rows, gap):
    by_path = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        groups = by_path[row[2]]
        if groups and row[1] - groups[-1][-1][1] <= gap:
            groups[-1].append(row)
        else:
            groups.append([row])
    return sorted((p, g[0][1], g[-1][1], len(g), g[-1][3], g[-1][4], g[-1][0]) for p, groups in by_path.items() for g in groups)


@pytest.mark.parametrize("gap", [1, 5, 10, 50])
@pytest.mark.parametrize("stretch", [2, 4096])
def test_debounce(frame, monkeypatch, gap, stretch):
    monkeypatch.setattr(E, "STRETCH", stretch)
    rng = random.Random(gap)
    rows = [(i, rng.randrange(-200, 800), rng.choice("aab"), rng.choice(("create", "modify")), rng.choice((None, "data"))) for i in range(150)]
    got = E.debounce(frame(rows, SCHEMA), gap).collect()
    assert sorted(map(tuple, got), key=str) == sorted(bursts(rows, gap), key=str)


def test_debounce_and_session_window_agree_on_the_gap(frame):
    """A pause of exactly the gap does not end a burst in either form."""
    rows = [(0, 0, "a", "create", None), (1, 10_000_000, "a", "modify", None), (2, 20_000_001, "a", "remove", None)]
    df = frame(rows, SCHEMA)
    batch = E.debounce(df, 10_000_000).count()
    timed = df.withColumn("ts", F.timestamp_micros("ts_micros"))
    stream_form = streams.debounce_stream(timed, "10 seconds").count()
    assert (batch, stream_form) == (2, 2)


def test_plan_and_inventory(frame):
    log = frame([(i, i, p, "create", None) for i, p in enumerate(["a/f", "b/f", "d", "gone", "a/f"])], SCHEMA)
    inventory = frame([("a/f", True, False), ("b/f", True, False), ("d", False, True)], "path string, is_file boolean, is_dir boolean")
    shown = lambda df: sorted((r.source, r.destination, r.effect) for r in df.collect())
    assert shown(E.plan_actions(log, "copy", "/o", inventory)) == [("a/f", "/o/f", "copy")] * 2 + [("b/f", "/o/f", "copy")]
    assert ("d", "/o/d", "move") in shown(E.plan_actions(log, "move", "/o", inventory))
    assert shown(E.plan_actions(log, "delete", inventory=inventory))[-1] == ("d", None, "delete")
    collisions = E.dest_collisions(E.plan_actions(log, "copy", "/o", inventory)).collect()
    assert [tuple(r) for r in collisions] == [("/o/f", 3, 2, "a/f")]
    for arguments in (("copy",), ("shred", "/o")):
        with pytest.raises(ValueError):
            E.plan_actions(log, *arguments)


def test_manifest_diff(frame):
    schema = "path string, length long, modified long, sha256 string"
    old = [("same", 1, 0, "s"), ("edited", 1, 0, "e1"), ("touched", 1, 0, "t"), ("gone", 1, 0, "g"), ("moved", 1, 0, "m"), ("nod", 1, 0, None)]
    new = [("same", 1, 0, "s"), ("edited", 1, 0, "e2"), ("touched", 1, 9, "t"), ("fresh", 1, 0, "f"), ("there", 1, 0, "m"), ("nod2", 1, 0, None)]
    old += [(f"c{i}", 0, 0, "copy") for i in range(30)]
    new += [(f"k{i}", 0, 0, "copy") for i in range(20)]
    rows = [tuple(r) for r in E.manifest_diff(frame(old, schema), frame(new, schema)).collect()]
    plain = {r for r in rows if not (r[2].startswith(("c", "k")))}
    assert plain == {
        ("modify", "data", "edited", None), ("modify", "data", "touched", None), ("remove", None, "gone", None),
        ("create", None, "fresh", None), ("modify", "name_both", "there", "moved"), ("remove", None, "nod", None),
        ("create", None, "nod2", None),
    }
    copies = [r for r in rows if r[2].startswith(("c", "k"))]
    assert Counter(r[0] for r in copies) == {"modify": 20, "remove": 10}
    renamed = [r for r in copies if r[0] == "modify"]
    assert {r[2] for r in renamed} == {f"k{i}" for i in range(20)} and len({r[3] for r in renamed}) == 20
    assert {r[3] for r in renamed} | {r[2] for r in copies if r[0] == "remove"} == {f"c{i}" for i in range(30)}


def plan(frame, steps):
    schema = "source string, destination string, effect string, ts_micros long, seq long"
    return frame([(*s, i, i) for i, s in enumerate(steps)], schema)


def test_actions(frame, tmp_path):
    source, out = tmp_path / "in", tmp_path / "new" / "out"
    source.mkdir()
    for name in ("copy", "move", "delete", "dry"):
        (source / name).write_bytes(name.encode())
    (source / "tree" / "sub").mkdir(parents=True)
    (source / "tree" / "sub" / "x").write_text("x")
    at = lambda name: str(source / name)
    to = lambda name: str(out / name)
    dry = writers.run_actions(plan(frame, [(at("dry"), None, "delete")])).collect()
    assert [r.done for r in dry] == [False] and (source / "dry").exists()
    steps = [
        (at("copy"), to("copy"), "copy"), (at("move"), to("move"), "move"), (at("delete"), None, "delete"),
        (at("tree"), None, "delete"), (at("missing"), to("missing"), "copy"), (at("missing2"), None, "delete"),
        (str(tmp_path), to("dir"), "copy"),
    ]
    report = {r.source: r for r in writers.run_actions(plan(frame, steps), dry_run=False).collect()}
    assert all(r.error is None for r in report.values())
    assert [report[s[0]].done for s in steps] == [True, True, True, True, False, False, False]
    assert (out / "copy").read_bytes() == b"copy" and (source / "copy").exists()
    assert (out / "move").read_bytes() == b"move" and not (source / "move").exists()
    assert not (source / "delete").exists() and not (source / "tree").exists()
    assert not list(out.glob("*.part"))


def test_an_unknown_scheme_is_a_row_and_actions_run_once(frame, tmp_path):
    (tmp_path / "a").write_text("x")
    steps = [("nosuch://h/a", str(tmp_path / "b"), "copy"), (str(tmp_path / "a"), str(tmp_path / "c"), "move")]
    report = writers.run_actions(plan(frame, steps), dry_run=False)
    for _ in range(2):  # a second action on the report only reads it
        rows = {r.effect: r for r in report.collect()}
        assert not rows["copy"].done and rows["copy"].error and rows["move"].done
    # an attempt after a lost one finds the file moved already
    again = writers.run_actions(plan(frame, steps[1:]), dry_run=False).first()
    assert again.done and again.error is None


def test_a_failing_action_is_a_row(frame, tmp_path):
    (tmp_path / "f").write_text("f")
    (tmp_path / "blocked").write_text("a file, not a folder")
    steps = [(str(tmp_path / "f"), str(tmp_path / "blocked" / "f"), "copy"), (str(tmp_path / "f"), str(tmp_path / "g"), "copy")]
    report = writers.run_actions(plan(frame, steps), dry_run=False)
    rows = {r.destination: (r.done, r.error is None) for r in report.collect()}
    assert rows == {steps[0][1]: (False, False), steps[1][1]: (True, True)}


def test_last_writer_wins(frame, tmp_path):
    for folder in "abc":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_text(folder)
    steps = [(str(tmp_path / folder / "f"), str(tmp_path / "out" / "f"), "move") for folder in "acb"]
    writers.run_actions(plan(frame, steps), dry_run=False).collect()
    assert (tmp_path / "out" / "f").read_text() == "b"
    assert not any((tmp_path / folder / "f").exists() for folder in "abc")


def test_copy_files(frame, tmp_path):
    (tmp_path / "a").write_bytes(bytes(1 << 20))
    pairs = frame([(str(tmp_path / "a"), str(tmp_path / "o" / "b"))], "source string, destination string")
    assert [r.done for r in writers.copy_files(pairs).collect()] == [True]
    assert (tmp_path / "o" / "b").read_bytes() == bytes(1 << 20)


def test_micros_do_not_depend_on_the_zone(spark):
    expression = micros(F.expr("TIMESTAMP_NTZ'2024-03-31 02:30:00.000123'"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    values = []
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            values.append(spark.range(1).select(expression.alias("v")).first().v)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert values == [1711852200000123] * 3


@pytest.fixture
def texts(spark, frame, tmp_path):
    rows = [(i, f"line\nlisten 10.0.0.{i % 3 + 1}\nplain") for i in range(20)]
    df = frame(rows, "id long, text string")
    df.repartition(4).write.parquet(str(tmp_path / "texts"))
    return df, str(tmp_path / "texts")


def test_scan_stream_equals_batch(spark, texts, tmp_path):
    batch, folder = texts
    source = streams.event_source(spark, folder, batch.schema, maxFilesPerTrigger="1")
    found = streams.scan_stream(source, default_rules())
    streams.write_available(found, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    expected = scan_text(batch, default_rules())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 20
    with pytest.raises(ValueError):
        streams.scan_stream(batch, default_rules())


def test_stream_dedup(spark, texts, tmp_path):
    batch, folder = texts
    source = streams.event_source(spark, folder, batch.schema, maxFilesPerTrigger="1")
    timed = source.withColumn("ts", F.timestamp_seconds("id"))
    found = streams.stream_dedup(streams.scan_stream(timed, default_rules(), redact=False), ["matched_text"], delay="1 day")
    streams.write_available(found.select("matched_text"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [r.matched_text for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]


def test_monitor_acts_on_arriving_events(spark, frame, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "copies"
    inbox.mkdir()
    for name in ("a", "b"):
        (inbox / name).write_text(name)
    log = frame(
        [(i, i * 1_000_000, str(inbox / p), kind, None) for i, (p, kind) in enumerate([("a", "create"), ("b", "access"), ("zz", "create")])],
        SCHEMA,
    )
    log.select("seq", F.timestamp_micros("ts_micros").alias("ts"), "path", "kind", "kind_detail").write.parquet(str(tmp_path / "log"))
    source = streams.event_source(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema)
    options = E.MonitorOptions((str(inbox),), "copy", str(out), on_create=True)
    report = str(tmp_path / "report")
    query = streams.monitor(source, options, out=report, checkpoint=str(tmp_path / "check"), dry_run=False, available_now=True)
    query.awaitTermination()
    rows = spark.read.parquet(report)
    assert {r.source.rsplit("/", 1)[1]: r.done for r in rows.collect()} == {"a": True, "zz": False}
    assert (out / "a").read_text() == "a" and not (out / "b").exists()
    assert streams.failed_actions(rows).count() == 0


def test_monitor_debounces(spark, frame, tmp_path):
    """A burst is one step; the last burst waits until the watermark has passed it."""
    second = 1_000_000
    times = [(0, "a"), (100_000, "a"), (200_000, "b"), (5 * second, "a"), (60 * second, "c")]
    log = frame([(i, t + 1000 * second, f"in/{p}", "modify", "data") for i, (t, p) in enumerate(times)], SCHEMA)
    log.select("seq", F.timestamp_micros("ts_micros").alias("ts"), "path", "kind", "kind_detail").write.parquet(str(tmp_path / "log"))
    source = streams.event_source(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema)
    options = E.MonitorOptions(("in",), "copy", "/out", on_modify=True)
    report = str(tmp_path / "report")
    streams.monitor(
        source, options, out=report, checkpoint=str(tmp_path / "check"), debounced=True, delay="1 second", available_now=True
    ).awaitTermination()
    rows = spark.read.parquet(report).collect()
    assert sorted((r.source, r.destination) for r in rows) == [("in/a", "/out/a"), ("in/b", "/out/b")]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a").write_text("a")
    (tmp_path / "in" / "sub" / "b").write_text("b")
    for recursive, expected in ((True, {"a", "b"}), (False, {"a"})):
        found = streams.arrivals(spark, str(tmp_path / "in"), recursive=recursive)
        out = str(tmp_path / f"out{recursive}")
        streams.write_available(found, out, str(tmp_path / f"check{recursive}"))
        assert {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect()} == expected
