from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.operators import edits as E
from siftworks.operators import patches as P
from siftworks.sources import chunks as C
from siftworks.sources.trees import walk_tree

BLOBS = {"a": bytes(range(256)) * 3, "b": b"x" * 100, "c": b"", "d/e": b"untouched" * 9}


def as_chunks(frame, chunk):
    rows = [(p, i // chunk, i, data[i : i + chunk]) for p, data in BLOBS.items() for i in range(0, len(data), chunk)]
    return frame(rows, "path string, chunk_no long, start long, content binary").repartition(3)


def joined(chunks):
    found = {}
    for r in chunks.collect():
        found.setdefault(r.path, {})[r.chunk_no] = bytes(r.content)
    return {p: b"".join(x[i] for i in sorted(x)) for p, x in found.items()}


@pytest.mark.parametrize("chunk", [1, 7, 100, 4096])
def test_edits_and_runs_against_whole_blobs(frame, chunk):
    rng = random.Random(chunk)
    log = frame(
        [(rng.choice("abc"), i, rng.randrange(0, 800), rng.choice((None, *range(256)))) for i in range(500)],
        "path string, seq long, offset long, byte short",
    )
    pending = E.last_edit_wins(log)
    runs = E.coalesce_runs(pending)
    blobs = frame(list(BLOBS.items()), "path string, content binary")
    wanted = {r.path: bytes(r.content) for r in E.apply_runs(blobs, runs).collect() if r.content}
    for pieces in (P.runs_in_chunks(pending, chunk), P.cut_runs(runs, chunk)):
        assert joined(P.patch_chunks(as_chunks(frame, chunk), pieces, chunk)) == wanted
        for r in pieces.collect():
            assert r.chunk_no == r.start // chunk == (r.start + len(r.bytes) - 1) // chunk


def test_the_edits_of_one_blob_spread(spark):
    """Half a million edits on one blob, every second byte of a megabyte: no row holds more than a chunk's."""
    pending = spark.range(1 << 19).select(F.lit("big").alias("path"), (F.col("id") * 2).alias("offset"), F.lit(1).cast("short").alias("byte"))
    pieces = P.runs_in_chunks(pending, 1 << 14)
    assert pieces.groupBy("path", "chunk_no").count().agg(F.max("count"), F.count("*")).first()[:2] == (1 << 13, 64)
    zeros = F.unhex(F.repeat(F.lit("00"), 1 << 14))
    chunks = spark.range(65).select(F.lit("big").alias("path"), F.col("id").alias("chunk_no"), (F.col("id") * (1 << 14)).alias("start"), zeros.alias("content"))
    done = P.patch_chunks(chunks, pieces, 1 << 14).select("chunk_no", F.md5(F.hex("content")).alias("m")).collect()
    assert len(done) == 65 and len({r.m for r in done if r.chunk_no < 64}) == 1 and len({r.m for r in done}) == 2


def test_files_from_patched_chunks(spark, frame, tmp_path):
    for name, data in BLOBS.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    chunks = C.read_chunks(C.plan_chunks(walk_tree(spark, str(tmp_path / "in")), chunk=64))
    pieces = P.cut_runs(frame([("a", 60, b"PATCHED"), ("a", 767, b"!!"), ("gone", 1, b"x")], "path string, start long, bytes binary"), 64)
    done = P.write_chunks(P.patch_chunks(chunks, pieces, 64), str(tmp_path / "out")).collect()
    assert {r.path: r.length for r in done} == {p: len(d) for p, d in BLOBS.items() if d}
    expected = bytearray(BLOBS["a"])
    expected[60:67], expected[767:768] = b"PATCHED", b"!"
    assert (tmp_path / "out" / "a").read_bytes() == expected
    assert (tmp_path / "out" / "d" / "e").read_bytes() == BLOBS["d/e"]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a", "b", "e"]
