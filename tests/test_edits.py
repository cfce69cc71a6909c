"""Edit logs: last edit, runs, patching and previews."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions import bytes as B
from siftworks.operators import edits as E

SCHEMA = "path string, seq long, offset long, byte smallint"


def log(seed, paths=3, size=60, count=200):
    rng = random.Random(seed)
    return [(f"p{rng.randrange(paths)}", i, rng.randrange(size), rng.randrange(256)) for i in range(count)]


def model(rows):
    """Last byte per path and offset, and the runs of contiguous offsets."""
    last = {}
    for path, _, offset, byte in sorted(rows, key=lambda r: r[1]):
        last.setdefault(path, {})[offset] = byte
    runs = []
    for path, cells in last.items():
        for offset in sorted(cells):
            if runs and runs[-1][0] == path and runs[-1][1] + len(runs[-1][2]) == offset:
                runs[-1][2].append(cells[offset])
            else:
                runs.append((path, offset, bytearray([cells[offset]])))
    return last, [(p, s, bytes(b)) for p, s, b in runs]


@pytest.mark.parametrize("stretch", [4, 16, 1 << 16])
@pytest.mark.parametrize("count", [30, 200])
def test_runs_across_stretches(frame, monkeypatch, stretch, count):
    monkeypatch.setattr(E, "STRETCH", stretch)
    rows = log(1, count=count)
    runs = E.coalesce_runs(E.last_edit_wins(frame(rows, SCHEMA))).collect()
    assert sorted((r.path, r.start, bytes(r.bytes)) for r in runs) == sorted(model(rows)[1])
    assert all(r.length == len(r.bytes) for r in runs)


def test_apply_runs(frame):
    rows = log(2, paths=4, size=40, count=60)
    contents = {"p0": bytes(50), "p1": bytes(range(20)), "p2": b"", "p3": b"z" * 40, "p9": b"untouched"}
    blobs = frame(list(contents.items()), "path string, content binary")
    runs = E.coalesce_runs(E.last_edit_wins(frame(rows, SCHEMA)))
    got = {r.path: bytes(r.content) for r in E.apply_runs(blobs, runs).collect()}
    expected = {}
    for path, content in contents.items():
        buffer = bytearray(content)
        for offset, byte in model(rows)[0].get(path, {}).items():
            if offset < len(buffer):
                buffer[offset] = byte
        expected[path] = bytes(buffer)
    assert got == expected


def test_preview(frame):
    blobs = frame([("p", bytes(range(65, 85))), ("q", b"same")], "path string, content binary")
    edits = frame([("p", 0, 1, 255), ("p", 1, 17, 10), ("p", 2, 99, 1)], SCHEMA)
    rows = E.edits_preview(blobs, E.last_edit_wins(edits)).orderBy("path", "row_offset").collect()
    assert [(r.path, r.offset, r.dirty) for r in rows] == [("p", "00000000", [1]), ("p", "00000010", [1]), ("q", "00000000", [])]
    assert rows[0].hex[:3] == ["41", "FF", "43"] and rows[0].ascii[:3] == "ABC"
    assert rows[1].hex == ["51", "0A", "53", "54"]


def test_invalid_bytes_are_dropped(frame):
    edits = frame([("p", 0, 1, 7), ("p", 1, 1, None)], SCHEMA)
    assert [tuple(r) for r in E.last_edit_wins(edits).collect()] == [("p", 1, 7)]


def test_write_commands(frame):
    blobs = frame([("w", b"HELLO_WORLD"), ("r", b"RUST"), ("i", b"ABCDEF"), ("x", b"XY"), ("g", b"FOO")], "path string, content binary")
    schema = (
        "path string, seq long, mode string, offset string, end_offset string, data binary, payload_path string, "
        "payload_offset long, append_zero boolean, reverse boolean, dialect string"
    )
    rows = [
        ("w", 0, "overwrite", "6", None, None, "r", None, False, False, "cli", b"HELLO_RUSTD"),
        ("i", 1, "insert", "3", None, None, "x", None, False, False, "cli", b"ABCXYDEF"),
        ("i", 2, "insert", "0x3", None, None, "x", 1, False, False, "cli", b"ABCYDEF"),
        ("i", 3, "overwrite", "eof", None, b"GH", None, None, False, True, "cli", b"ABCDEFHG"),
        ("i", 4, "overwrite", "bad", None, b"z", None, None, False, False, "cli", b"zBCDEF"),
        ("i", 5, "overwrite", "1", "3", b"xy", None, None, False, False, "cli", b"AxyDEF"),
        ("i", 6, "insert", "4", "1", b"xy", None, None, False, False, "cli", b"AyxBCDEF"),
        ("g", 7, "overwrite", "9", None, b"z", None, None, False, False, "gui", None),
        ("g", 8, "insert", "9", None, b"z", None, None, False, False, "gui", b"FOOz"),
        ("g", 9, "overwrite", "0", "2", b"abc", None, None, False, True, "gui", b"cba"),
        ("g", 10, "overwrite", "2k", None, b"z", None, None, False, False, "gui", b"FOz"),
        ("g", 11, "overwrite", "zz", None, b"z", None, None, False, False, "gui", None),
        ("g", 12, "insert", "eof", None, b"z", None, None, False, False, "gui", None),
        ("g", 13, "overwrite", "0", "q", b"z", None, None, False, False, "gui", None),
        ("g", 14, "insert", "0", None, None, "nowhere", None, False, False, "cli", None),
        ("g", 15, "overwrite", "eof", "2", b"z", None, None, False, False, "cli", None),
        ("g", 16, "insert", "3000000000", None, b"z", None, None, False, False, "cli", None),
        ("g", 17, "overwrite", "9223372036854775807", None, b"z", None, None, True, False, "gui", None),
        ("g", 18, "overwrite", "-9223372036854775808", "9223372036854775807", b"z", None, None, True, False, "gui", None),
    ]
    commands = frame([r[:-1] for r in rows], schema)
    got = {r.seq: r for r in E.edit_results(blobs, E.payload_join(commands, blobs)).collect()}
    for row in rows:
        content = got[row[1]].content
        assert (None if content is None else bytes(content)) == row[-1], row
    assert got[7].error and got[8].error is None
    assert all((r[-1] is None) == (got[r[1]].error is not None) for r in rows)


def test_run_window_is_bounded(frame):
    """Isolated edits inside a stretch never reach the window that joins stretches."""
    edits = frame([("p", i, i * 2 + 1, 1) for i in range(50)], SCHEMA)
    plan = E.coalesce_runs(E.last_edit_wins(edits))
    assert plan.count() == 50
    islands = E.edit_islands(E.last_edit_wins(edits))
    assert islands.select(F.countDistinct("island")).first()[0] == 50


def test_offsets_at_the_ends_of_the_range_fail_no_job(frame):
    ends = (0, 2**63 - 1, -(2**63), 3 * 10**9, -3 * 10**9, 2**31)
    table = frame([(a, b) for a in ends for b in ends], "a long, b long").withColumn("c", F.lit(b"abc"))
    a, b, c, d = F.col("a"), F.col("b"), F.col("c"), F.lit(b"xy")
    forms = [
        B.byte_range(c, a, b), B.byte_range(c, a, None), B.byte_range(c, a, b, "gui")["bytes"], B.byte_page(c, a),
        B.overwrite_at(c, a, d), B.overwrite_at(c, a, d, append_zero=True),
        B.overwrite_at(c, a, d, append_zero=True, dialect="gui")["content"],
        B.overwrite_range(c, a, b, d, append_zero=True), B.overwrite_range(c, a, b, d, dialect="gui")["content"],
        B.insert_at(c, a, d), B.insert_at(c, a, d, dialect="gui"), B.insert_range(c, a, b, d),
        B.patch_hex(c, a, F.lit("FF"))["content"], B.read_bytes_padded(c, a, 4),
    ]
    rows = table.select("a", "b", *[f.alias(f"f{i}") for i, f in enumerate(forms)]).collect()
    assert len(rows) == len(ends) ** 2
    whole = next(r for r in rows if r.a == 0 and r.b == 2**63 - 1)
    assert bytes(whole.f0) == bytes(whole.f1) == bytes(whole.f2) == b"abc"
    far = next(r for r in rows if r.a == 3 * 10**9 and r.b == 0)
    assert far.f5 is None and far.f9 is None and bytes(far.f10) == b"abcxy"
