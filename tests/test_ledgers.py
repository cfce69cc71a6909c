from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions.rules import default_rules
from siftworks.operators.match import scan_text
from siftworks.plans import registry, scans
from siftworks.streaming import ledgers, streams

FOUND = "ts long, rule string, file string, text string"


def batches_of(frame, rows, schema, folder, count):
    """Rows as ``count`` files, which arrive one by one."""
    for i in range(count):
        frame(rows[i::count], schema).coalesce(1).write.mode("append").parquet(folder)
    return frame([], schema).schema


def deduped(spark, folder, schema, at, **options):
    source = streams.event_source(spark, folder, schema, maxFilesPerTrigger="1")
    ledgers.dedup_with_ledger(
        source, ["rule", "file", "text"], ledger=f"{at}/ledger", out=f"{at}/out", checkpoint=f"{at}/check", available_now=True, **options
    ).awaitTermination()
    return sorted(map(tuple, ledgers.read_batches(spark, f"{at}/out", schema).collect()), key=str)


@pytest.mark.parametrize("merge_every", [2, 100])
def test_one_finding_per_key_for_good(spark, frame, tmp_path, merge_every):
    rng = random.Random(merge_every)
    pick = lambda *values: rng.choice(values)
    # times spread over years and out of order; null and empty keys
    rows = [(rng.randrange(10**9), pick("a", "b"), pick("x", "", None), pick("1", "12", None, "2")) for _ in range(160)]
    schema = batches_of(frame, rows, FOUND, str(tmp_path / "in"), 5)
    found = deduped(spark, str(tmp_path / "in"), schema, tmp_path, buckets=4, merge_every=merge_every)
    assert sorted((r[1:] for r in found), key=str) == sorted({r[1:] for r in rows}, key=str)
    assert set(found) <= set(rows)
    # after a restart, what is known stays known
    more = [(5, "a", "x", "1"), (6, "new", None, None), (7, "new", None, None)]
    frame(more, FOUND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = deduped(spark, str(tmp_path / "in"), schema, tmp_path, buckets=4, merge_every=merge_every)
    assert sorted(set(again) - set(found)) == [(6, "new", None, None)] and len(again) == len(found) + 1


def test_a_batch_that_runs_again_replaces_its_rows(spark, frame, tmp_path):
    ledger = ledgers.BatchLedger(spark, str(tmp_path), buckets=4, merge_every=2)
    rows = frame([(1, "a", "x", "1"), (2, "b", "x", "1")], FOUND)
    for batch_id in range(4):
        own = rows.withColumn("file", F.lit(f"f{batch_id}"))
        for _ in range(2):  # the second run must not see the first
            fresh = ledgers.first_findings(own, ["rule", "file"], ledger, batch_id)
            assert fresh.count() == 2
            ledger.put(batch_id, fresh.select("key"))
        assert ledgers.first_findings(own, ["rule", "file"], ledger, batch_id + 1).count() == 0
    assert ledger.before(4).count() == 8 and ledger.latest(3).count() == 6


def test_a_generation_that_was_not_finished_is_not_read(spark, frame, tmp_path):
    ledger = ledgers.BatchLedger(spark, str(tmp_path), merge_every=1)
    keys = lambda *names: frame([(n.encode(),) for n in names], "key binary")
    for batch_id, names in enumerate(["a", "bc", "d"]):
        ledger.put(batch_id, keys(*names))
    (tmp_path / "merged" / "upto=1" / "_SUCCESS").unlink()
    assert sorted(bytes(r.key) for r in ledger.before(3).select("key").collect()) == [b"a", b"b", b"c", b"d"]


def test_only_buckets_in_use_are_read(spark, frame, tmp_path):
    ledger = ledgers.BatchLedger(spark, str(tmp_path), buckets=16)
    ledger.put(0, frame([(bytes([i]),) for i in range(200)], "key binary"))
    rows = ledger.before(1, [3])
    assert {r.bucket for r in rows.collect()} == {3}
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]")[0]


VERSION = "path string, version long, text string"
LINES = ["plain", "listen 10.0.0.1", "listen 10.0.0.2", "x = 1", "", "listen 10.0.0.3"]


def found_lines(df, *columns):
    return sorted(map(tuple, df.select(*columns, "location.path", "location.line_no", "rule_name", "matched_text").collect()), key=str)


def stream_versions(spark, folder, schema, at, options, **settings):
    source = streams.event_source(spark, folder, schema, maxFilesPerTrigger="1")
    ledgers.scan_version_stream(
        source, options, state=f"{at}/state", out=f"{at}/out", checkpoint=f"{at}/check", available_now=True, **settings
    ).awaitTermination()
    return ledgers.read_findings(spark, f"{at}/out", options)


@pytest.mark.parametrize("merge_every", [1])
def test_versions_in_batches_equal_deltas(spark, frame, tmp_path, merge_every):
    rng = random.Random(5)
    options = scans.ScanOptions(ignore=("skipped",))
    text = lambda: rng.choice(("\n", "\r\n")).join(rng.choice(LINES) for _ in range(rng.randrange(0, 12)))
    versions = [{f"d{i}.py": text() for i in range(12)} for _ in range(4)]
    for version in versions[1:]:
        for name in rng.sample(sorted(version), 4):
            del version[name]  # not every file has every version
    versions[2] |= {"skipped/a.py": LINES[1], "late.py": LINES[1], "empty.py": "", "null.py": None}
    schema = None
    for n, version in enumerate(versions):
        schema = batches_of(frame, [(p, n, t) for p, t in version.items()], VERSION, str(tmp_path / "in"), 1)
        if n == 1:  # the query ends and starts again
            stream_versions(spark, str(tmp_path / "in"), schema, tmp_path, options, buckets=4, merge_every=merge_every)
    found = stream_versions(spark, str(tmp_path / "in"), schema, tmp_path, options, buckets=4, merge_every=merge_every)
    known, wanted = {}, []
    for n, version in enumerate(versions):
        sides = [frame(list(x.items()), "path string, text string") for x in (known, version)]
        wanted += [(n, *row) for row in found_lines(scans.scan_delta(*sides, options))]
        known |= version
    assert found_lines(found, "version") == sorted(wanted, key=str) and wanted


def test_versions_of_one_file_in_one_batch(spark, frame, tmp_path):
    rows = [("a.py", 3, "listen 10.0.0.1\nlisten 10.0.0.3"), ("a.py", 1, "listen 10.0.0.1"), ("a.py", 2, "listen 10.0.0.1\n")]
    schema = batches_of(frame, rows, VERSION, str(tmp_path / "in"), 1)
    options = scans.ScanOptions()
    found = stream_versions(spark, str(tmp_path / "in"), schema, tmp_path, options)
    assert [r[:3] for r in found_lines(found, "version")] == [(1, "a.py", 1), (3, "a.py", 2)]


def test_batches_are_refused(spark, frame, tmp_path):
    with pytest.raises(ValueError):
        ledgers.dedup_with_ledger(frame([], FOUND), ledger="l", out="o", checkpoint="c")
    with pytest.raises(ValueError):
        ledgers.scan_version_stream(frame([], VERSION), scans.ScanOptions(), state="s", out="o", checkpoint="c")
    assert scan_text(frame([("x",)], "text string"), default_rules()).count() == 0


def test_a_batch_of_a_large_table_is_several_files(spark, tmp_path):
    rows = spark.range(0, 900, 1, 18).select("id", F.lit("x").alias("text"))
    stream = registry._in_batches(rows, "many")
    sizes = []
    writer = stream.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
    writer.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert [files for _, files in sizes] == [5] * 4 and sum(n for n, _ in sizes) == 900
