from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions import bytes as B
from siftworks.operators.blobs import scan_strings
from siftworks.operators.match import explode_lines
from siftworks.sources import chunks as C
from siftworks.sources.readers import decode_text
from siftworks.sources.trees import walk_tree, with_content

CONTENTS = {
    "empty": b"",
    "one": b"x",
    "lines": b"first\nsecond\r\n\nlast",
    "ended": b"first\r\n\r\nsecond\r\n",
    "breaks": b"\n" * 40,
    "return": b"a\rb\n\r\n\r",
    "wide": "é日本🎉\n".encode() * 20,
    "broken": b"good\n" + b"\xff\xfe" * 10 + b"\ngood\n",
    "long": b"abc" * 200,
    "strings": b"\x00ab\x00abcd\x01" + b"z" * 100 + b"\x00" * 33 + b"tail",
    "random": bytes(random.Random(1).choices(range(256), k=700)),
    "near": bytes(random.Random(2).choices(b"ab\n\r\x00", k=500)),
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("chunks")
    for name, content in CONTENTS.items():
        (root / name).write_bytes(content)
    return walk_tree(spark, str(root)).persist()


def whole(files):
    return with_content(files).select("path", "content")


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_chunks_hold_the_files(files, chunk):
    parts = {}
    for r in C.read_chunks(C.plan_chunks(files, chunk=chunk)).collect():
        assert len(r.content) == r["size"] and r.start == r.chunk_no * chunk
        parts.setdefault(r.path, {})[r.chunk_no] = bytes(r.content)
    assert {p: b"".join(x[i] for i in range(len(x))) for p, x in parts.items()} == {k: v for k, v in CONTENTS.items() if v}


@pytest.mark.parametrize("chunk", [1, 64])
def test_lines_across_borders(files, chunk):
    found = C.chunk_lines(C.read_chunks(C.plan_chunks(files, chunk=chunk)))
    wanted = explode_lines(decode_text(whole(files)))
    rows = lambda df: sorted((r.path, r.line_no, r.line) for r in df.collect())
    assert rows(found) == rows(wanted) and "broken" not in {r.path for r in found.collect()}


@pytest.mark.parametrize("chunk,least", [(1, 1), (6, 4), (64, 4)])
def test_strings_across_borders(files, chunk, least):
    found = C.chunk_strings(C.read_chunks(C.plan_chunks(files, chunk=chunk)), min_length=least)
    rows = sorted((r.path, r.offset, r.value) for r in found.collect())
    assert rows == sorted(map(tuple, scan_strings(whole(files), min_length=least).collect()))
    assert all(r.length == len(r.value) for r in found.collect())


def test_a_string_too_long_for_a_value(files, monkeypatch):
    monkeypatch.setattr(C, "MOST_VALUE", 300)
    found = {(r.path, r.offset): r for r in C.chunk_strings(C.read_chunks(C.plan_chunks(files, chunk=64))).collect()}
    assert found["long", 0].value is None and found["long", 0].length == 600


@pytest.mark.parametrize("dialect", ["cli", "gui"])
def test_ranges_are_those_of_blobs(files, dialect):
    spans = [(a, b) for a in (-9, -1, 0, 3, 19, 700) for b in (-12, -2, 0, 3, 64, 699, 5000, None)]
    blobs = whole(files)
    for a, b in spans[:: 7 if dialect == "cli" else 9]:
        bounds = C.range_bounds(F.col("length"), a, b, dialect)
        found = C.read_range(files, bounds["first"], bounds["last"], chunk=16)
        wanted = B.byte_range(F.col("content"), a, b, dialect)
        data = wanted if dialect == "cli" else wanted["bytes"]
        rows = {r.path: bytes(r.content) for r in found.collect()}
        assert rows == {r.path: bytes(r.d or b"") for r in blobs.select("path", data.alias("d")).collect()}, (a, b)
        if dialect == "gui":
            errors = {r.path: r.e for r in files.select("path", bounds["error"].alias("e")).collect()}
            assert errors == {r.path: r.e for r in blobs.select("path", wanted["error"].alias("e")).collect()}
    with pytest.raises(ValueError):
        C.range_bounds(F.col("length"), 0, 1, "tui")


def test_a_page_reads_its_bytes_only(files):
    big = files.where("path = 'random'")
    plan = C.plan_chunks(big, chunk=256, first=F.lit(250), last=F.lit(260))
    assert [(r.chunk_no, r.start, r["size"]) for r in plan.orderBy("chunk_no").collect()] == [(0, 250, 6), (1, 256, 5)]
    assert C.plan_chunks(big, chunk=64).where("chunk_no = 3").count() == 1
    for offset in (-100, 100, 690, 5000):
        found = {r.path: bytes(r.content) for r in C.read_page(files, offset, 64, chunk=50).collect()}
        page = B.byte_page(F.col("content"), offset, 64)
        assert found == {r.path: bytes(r.p) for r in whole(files).select("path", page.alias("p")).collect()}


def test_files_that_went_away(spark, files, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    listed = walk_tree(spark, str(tmp_path))
    (tmp_path / "x").unlink()
    assert C.read_chunks(C.plan_chunks(listed)).count() == 0


def test_chunks_are_read_once(files):
    found = C.chunk_strings(C.read_chunks(C.plan_chunks(files, chunk=64)))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
