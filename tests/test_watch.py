from __future__ import annotations

import os
import time

import pytest

from siftworks.operators.events import manifest_diff
from siftworks.sources import watch
from siftworks.streaming import streams


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def arrived(spark, store, out, checkpoint, **options):
    """Run the stream over what is there now and give everything it has written so far."""
    stream = watch.watch_events(spark, str(store), **options)
    streams.write_available(stream.drop("ts"), str(out), str(checkpoint))
    return sorted(map(tuple, spark.read.schema(stream.drop("ts").schema).parquet(str(out)).collect()), key=str)


def test_events_across_restarts(spark, tmp_path):
    root, store, out, checkpoint = (tmp_path / n for n in ("in", "store", "out", "check"))
    put(root, a="a", b="b", sub__c="c", d="d", old="moved")
    shown = lambda: [(r[0].removeprefix(f"{root}/"), *r[1:3], r[3] and r[3].removeprefix(f"{root}/"), r[5]) for r in arrived(spark, store, out, checkpoint)]
    assert watch.take_inventory(spark, [str(root)], str(store)) == 0
    assert shown() == []
    put(root, b="changed", sub__new="n")
    (root / "a").unlink()
    (root / "old").rename(root / "sub" / "renamed")
    assert watch.take_inventory(spark, [str(root)], str(store)) == 1
    first = [
        ("a", "remove", None, None, 1), ("b", "modify", "data", None, 1), ("sub/new", "create", None, None, 1),
        ("sub/renamed", "modify", "name_both", "old", 1),
    ]
    assert sorted(shown()) == first
    # nothing new, then two versions at once
    assert sorted(shown()) == first
    put(root, a="again")
    watch.take_inventory(spark, [str(root)], str(store))
    (root / "a").unlink()
    watch.take_inventory(spark, [str(root)], str(store))
    assert sorted(shown()) == sorted([*first, ("a", "create", None, None, 2), ("a", "remove", None, None, 3)])
    late = arrived(spark, store, tmp_path / "out2", tmp_path / "check2", start="newest")
    assert late == []


def test_events_are_those_of_the_inventories(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    put(root, **{f"f{i}": f"text {i % 7}" for i in range(40)})
    watch.take_inventory(spark, [str(root)], str(store))
    for i in range(0, 40, 3):
        (root / f"f{i}").rename(root / f"g{i}")
    for i in range(1, 40, 3):
        (root / f"f{i}").unlink()
    put(root, **{f"h{i}": f"text {i}" for i in range(5, 12)})
    watch.take_inventory(spark, [str(root)], str(store))
    sides = [watch.read_inventory(spark, str(store), v).withColumnRenamed("key", "path").drop("at") for v in (0, 1)]
    wanted = sorted((f"{root}/{r.path}", r.kind, r.kind_detail, r.from_path and f"{root}/{r.from_path}") for r in manifest_diff(*sides).collect())
    assert [r[:4] for r in arrived(spark, store, tmp_path / "out", tmp_path / "check")] == sorted(wanted, key=str)


def test_an_inventory_that_died_is_taken_again(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    put(root, a="a")
    watch.take_inventory(spark, [str(root)], str(store))
    put(root, b="b")
    watch.take_inventory(spark, [str(root)], str(store))
    os.remove(store / "committed" / f"{1:012d}")  # as if the job had died before its end
    assert watch.committed_versions(str(store)) == [0]
    put(root, c="c")
    assert watch.take_inventory(spark, [str(root)], str(store)) == 1
    found = arrived(spark, store, tmp_path / "out", tmp_path / "check")
    assert [(r[0].rsplit("/", 1)[1], r[1]) for r in found] == [("b", "create"), ("c", "create")]


def test_targets(spark, tmp_path):
    """Several targets, a single file among them, one below another, one missing; shallow and pruned."""
    root, store = tmp_path / "in", tmp_path / "store"
    put(root, x__a="a", x__deep__b="b", y="y", z="z")
    targets = [str(root / "x"), str(root / "y"), str(root / "x" / "deep"), str(root / "gone")]
    watch.take_inventory(spark, targets, str(store))
    listed = {r.at.removeprefix(f"{root}/") for r in watch.read_inventory(spark, str(store), 0).collect()}
    assert listed == {"x/a", "x/deep/b", "y"}
    (root / "y").rename(root / "x" / "y2")
    watch.take_inventory(spark, targets, str(store))
    (only,) = arrived(spark, store, tmp_path / "out", tmp_path / "check")
    assert only[:4] == (f"{root}/x/y2", "modify", "name_both", f"{root}/y")
    watch.take_inventory(spark, [str(root)], str(tmp_path / "shallow"), recursive=False)
    assert {r.key for r in watch.read_inventory(spark, str(tmp_path / "shallow"), 0).collect()} == {"z"}


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    put(root, a="one", b="two")
    watch.take_inventory(spark, [str(root)], str(store))
    kept = os.stat(root / "a")
    (root / "a").write_text("eno")
    os.utime(root / "a", ns=(kept.st_atime_ns, kept.st_mtime_ns))  # same length and time: taken for unchanged
    (root / "b").write_text("owt")
    watch.take_inventory(spark, [str(root)], str(store))
    assert [r[0].rsplit("/", 1)[1] for r in arrived(spark, store, tmp_path / "out", tmp_path / "check")] == ["b"]


def test_a_running_watch(spark, tmp_path):
    root, store, out = tmp_path / "in", tmp_path / "store", tmp_path / "out"
    put(root, a="a")
    with watch.FolderWatch(spark, [str(root)], str(store), every=0.2):
        stream = watch.watch_events(spark, str(store), start="newest").drop("ts")
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            put(root, b="b")
            deadline = time.time() + 90
            rows = []
            while not rows and time.time() < deadline:
                time.sleep(0.5)
                rows = spark.read.schema(stream.schema).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
        finally:
            query.stop()
    assert [(r.path.rsplit("/", 1)[1], r.kind) for r in rows] == [("b", "create")]


def test_options(spark, tmp_path):
    spark.dataSource.register(watch.InventoryEvents)
    for options in ({}, {"store": str(tmp_path), "start": "middle"}):
        with pytest.raises(Exception, match="store|start"):  # noqa: B017, PT011
            stream = spark.readStream.format(watch.SOURCE).options(**options).load()
            streams.write_available(stream, str(tmp_path / "o"), str(tmp_path / "c"))
