"""Byte expressions against stated cases and plain slicing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions import bytes as B
from siftworks.functions.genres import GENRES, genre_lookup
from siftworks.operators.blobs import blob_chunks, hex_dump, scan_strings, strings_filter, strings_shown, verify_copy

C, D = F.col("content"), F.col("data")
AT, TILL = F.col("at"), F.col("till")


def column(frame, rows, schema, expression):
    df = frame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", expression.alias("v"))
    values = [r.v for r in sorted(df.collect(), key=lambda r: r.i)]
    return [bytes(v) if isinstance(v, bytearray) else v for v in values]


def test_byte_range_cases(frame):
    rows = [(-4, -2), (-2, -4), (1000, 2000), (2, 3), (0, 99), (-9, 2), (5, 5)]
    got = column(frame, [(b"abcdef", s, e) for s, e in rows], "content binary, at long, till long", B.byte_range(C, AT, TILL))
    assert got == [b"cde", b"", b"", b"cd", b"abcdef", b"", b"f"]
    to_end = column(frame, [(b"abcdef", s) for s in (2, -2, -99, 6)], "content binary, at long", B.byte_range(C, AT, None))
    assert to_end == [b"cdef", b"ef", b"abcdef", b""]
    gui = column(
        frame, [(b"abcdef", s, e) for s, e in [(-4, -2), (-99, 2), (3, 2), (6, 9), (2, 9), (2, B.I64_MAX)]],
        "content binary, at long, till long", B.byte_range(C, AT, TILL, "gui"),
    )
    assert [(None if r["bytes"] is None else bytes(r["bytes"]), r["error"] is None) for r in gui] == [
        (b"cde", True), (b"abc", True), (b"", True), (b"", True), (None, False), (b"cdef", True)
    ]
    assert column(frame, [(b"", 0, B.I64_MAX)], "content binary, at long, till long", B.byte_range(C, AT, TILL, "gui"))[0]["bytes"] == b""


def test_write_cases(frame):
    zeros = b"\0"
    cases = [
        (B.overwrite_at(C, AT, D, reverse=True), b"FOOBAR", 2, 0, b"foo", b"FOoofR"),
        (B.overwrite_range(C, AT, TILL, D), b"FOOBAR", 5, 2, b"foo", b"FOoofR"),
        (B.overwrite_range(C, AT, TILL, D), b"FOOBAR", 2, 4, b"foo", b"FOOBAR"),
        (B.overwrite_at(C, AT, D), b"FOOBAR", -2, 0, b"foobar", b"FOOBfo"),
        (B.overwrite_at(C, AT, D, append_zero=True), b"FOOBAR", -2, 0, b"foobar", b"FOOBfoobar"),
        (B.overwrite_at(C, AT, D), b"FOOBAR", 6, 0, b"foo", b"FOOBARfoo"),
        (B.overwrite_at(C, AT, D), b"FOOBAR", 9999, 0, b"FOO", b"FOOBAR"),
        (B.overwrite_at(C, AT, D, append_zero=True), b"FOO", 1000, 0, b"foo", b"FOO" + zeros * 997 + b"foo"),
        (B.overwrite_range(C, AT, TILL, D, append_zero=True), b"FOO", 2, 5, b"abc", b"FOa" + zeros * 2),
        (B.overwrite_range(C, AT, TILL, D), b"FOO", 2, 5, b"abc", b"FOa"),
        (B.insert_at(C, AT, D, reverse=True), b"FOOBAR", 3, 0, b"foo", b"FOOoofBAR"),
        (B.insert_range(C, AT, TILL, D), b"FOOBAR", 5, 3, b"foo", b"FOOoofBAR"),
        (B.insert_at(C, AT, D), b"FOOBAR", -3, 0, b"XY", b"FOOXYBAR"),
        (B.insert_at(C, AT, D), b"ABC", 100, 0, b"XY", b"ABC" + zeros * 97 + b"XY"),
        (B.insert_at(C, AT, D), b"ABC", 100, 0, b"", b"ABC"),
        (B.insert_at(C, AT, D, dialect="gui"), b"ABC", 100, 0, b"XY", b"ABCXY"),
        (B.insert_range(C, AT, TILL, D), b"ABC", 5, 9, b"", b"ABC" + zeros * 2),
        (B.append_eof(C, D), b"ABC", 0, 0, b"DEF", b"ABCDEF"),
        (B.overwrite_at(C, AT, D, dialect="gui")["content"], b"FOOBAR", 6, 0, b"foo", b"FOOBAR"),
        (B.overwrite_at(C, AT, D, dialect="gui")["content"], b"FOOBAR", 9, 0, b"foo", None),
        (B.overwrite_at(C, AT, D, dialect="gui", append_zero=True)["content"], b"FOOBAR", 4, 0, b"foo", b"FOOBfo"),
        (B.overwrite_at(C, AT, D, dialect="gui", append_zero=True)["content"], b"FOO", 4, 0, b"foo", b"FOO" + zeros + b"foo"),
        (B.overwrite_range(C, AT, TILL, D, dialect="gui")["content"], b"FOOBAR", 4, 2, b"foo", b"FOoofR"),
        (B.overwrite_range(C, AT, TILL, D, dialect="gui", reverse=True)["content"], b"FOOBAR", 4, 2, b"foo", b"FOfooR"),
        (B.overwrite_range(C, AT, TILL, D, dialect="gui")["content"], b"FOOBAR", 2, 5, b"foo", None),
        (B.overwrite_range(C, AT, TILL, D, dialect="gui")["content"], b"FOO", 5, 6, b"ab", b"FOO" + zeros * 2 + b"ab"),
    ]
    schema = "content binary, at long, till long, data binary"
    rows = frame([c[1:5] for c in cases], schema)
    for number, (expression, content, at, till, data, expected) in enumerate(cases):
        one = rows.filter((C == F.lit(content)) & (AT == at) & (TILL == till) & (D == F.lit(data))).select(expression.alias("v"))
        value = one.first().v
        assert (None if value is None else bytes(value)) == expected, number


def resolve(offset, n):
    return max(n + offset, 0) if offset < 0 else offset


def model(kind, content, at, till, data, grow, turn):
    """The write operators spelled out on a mutable buffer."""
    buffer, n = bytearray(content), len(content)
    p, q = resolve(at, n), resolve(till, n)
    low, high = min(p, q), max(p, q)
    turned = data[::-1] if turn else data
    if kind == "overwrite_at":
        if p > n and not grow:
            return content
        if p > n:
            return bytes(buffer) + b"\0" * (p - n) + turned
        room = len(turned) if p == n or grow else n - p
        for i, byte in enumerate(turned[:room]):
            if p + i < len(buffer):
                buffer[p + i] = byte
            else:
                buffer.append(byte)
    elif kind == "overwrite_range":
        if len(data) != high - low:
            return content
        turned = data[::-1] if turn or p > q else data
        for i, byte in enumerate(turned):
            if low + i < len(buffer):
                buffer[low + i] = byte
        if grow:
            buffer.extend(b"\0" * (high - len(buffer)))
    elif kind == "insert_at":
        if data:
            buffer.extend(b"\0" * (p - n))
            buffer[p:p] = turned
    else:
        turned = data[::-1] if turn or p > q else data
        buffer.extend(b"\0" * (low - n))
        buffer[low:low] = turned
    return bytes(buffer)


@pytest.mark.parametrize("kind", ["overwrite_at", "overwrite_range", "insert_at", "insert_range"])
def test_writes_on_random_bytes(frame, kind):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        content = rng.randbytes(rng.randrange(0, 12))
        at, till = rng.randrange(-15, 16), rng.randrange(-15, 16)
        span = abs(resolve(at, len(content)) - resolve(till, len(content)))
        data = rng.randbytes(span if rng.random() < 0.7 else rng.randrange(0, 6))
        rows.append((content, at, till, data, rng.random() < 0.5, rng.random() < 0.5))
    grow, turn = F.col("grow"), F.col("turn")
    expression = {
        "overwrite_at": B.overwrite_at(C, AT, D, append_zero=grow, reverse=turn),
        "overwrite_range": B.overwrite_range(C, AT, TILL, D, append_zero=grow, reverse=turn),
        "insert_at": B.insert_at(C, AT, D, reverse=turn),
        "insert_range": B.insert_range(C, AT, TILL, D, reverse=turn),
    }[kind]
    schema = "content binary, at long, till long, data binary, grow boolean, turn boolean"
    assert column(frame, rows, schema, expression) == [model(kind, *r) for r in rows]


def test_small_functions(frame):
    every = bytes(range(256))
    rows = [(every,), (b"",), (b"\x00\xff\n",)]
    assert column(frame, rows, "content binary", B.reverse_bytes(C)) == [r[0][::-1] for r in rows]
    assert column(frame, rows, "content binary", B.hex_cells(C)) == [r[0].hex(" ") for r in rows]
    assert column(frame, [(b"\x01\xab",)], "content binary", B.hex_cells(C, prefix=True)) == ["0x01 0xab"]
    assert column(frame, [(b"abcde",), (b"abc",)], "content binary", B.header4(C)) == ["0x61 0x62 0x63 0x64", None]
    assert column(frame, [(b"abc",)], "content binary", B.read_bytes_padded(C, 1, 4)) == [b"bc\0\0"]
    page = column(frame, [(bytes(600), a) for a in (-5, 100, 700)], "content binary, at long", B.byte_page(C, AT))
    assert [len(p) for p in page] == [512, 500, 0]
    typed = ["f", "1g2", "zz", "", "A:b", "100"]
    assert column(frame, [(t,) for t in typed], "t string", B.parse_hex_byte(F.col("t"))) == [15, 18, None, None, 171, 16]


def test_payload(frame):
    rows = [(b"RUST", None), (b"RUST", 2), (b"RUST", 4), (b"RUST", 99)]
    assert column(frame, rows, "content binary, at long", B.payload(C, AT)) == [b"RUST", b"ST", b"", b""]


def test_parse_int(frame):
    words = [" 12 ", "+5", "-5", "0x1F", "-0X1f", "0x", "0xg", "1.5", "9" * 19, "0x7FFFFFFFFFFFFFFF", "0xFFFFFFFFFFFFFFFF",
             "0x" + "F" * 30, "12ab", "0x1Fzz", "-", "", "-0x", None]
    signed = [12, 5, -5, 31, -31, None, None, None, None, 2**63 - 1, None, None, None, None, None, None, None, None]
    rows = [(w,) for w in words]
    assert column(frame, rows, "t string", B.parse_int_auto(F.col("t"))) == signed
    unsigned = [None if v is not None and w.strip().startswith("-") else v for w, v in zip(words, signed, strict=True)]
    assert column(frame, rows, "t string", B.parse_int_auto(F.col("t"), unsigned=True)) == unsigned
    lenient = column(frame, rows, "t string", B.parse_int_auto(F.col("t"), "gui"))
    assert lenient[:5] == [12, 5, -5, 31, -31] and lenient[7] == 1 and lenient[12:14] == [12, 31]


def test_patch(frame):
    rows = [(b"abcdef", 1, "DE AD"), (b"abcdef", -1, "dead"), (b"abcdef", 0, "abc"), (b"abcdef", 0, "zz"), (b"abc", 3, "00"),
            (b"abc", None, "00")]
    got = column(frame, rows, "content binary, at long, t string", B.patch_hex(C, AT, F.col("t")))
    shown = [(None if r["content"] is None else bytes(r["content"]), r["bytes_written"], r["start"]) for r in got]
    assert shown[:2] == [(b"a\xde\xaddef", 2, 1), (b"abcde\xde", 1, 5)]
    assert shown[2:] == [(None, None, None)] * 4
    assert [r["error"] for r in got[2:]] == [
        "hex bytes must have an even number of hex digits", "no hex bytes provided", "offset 0x3 is at or past EOF (3)",
        "invalid offset",
    ]


def test_types(frame):
    body = bytes(100)
    rows = [b"\xff\xd8\xff\xe0" + body + b"\xff\xd9", b"\xff\xd8" + body, b"BM" + body, b"GIF8" + body, b"\x89PNG" + body,
            b"MZ" + body, b"\xca\xfe\xba\xbe" + body, b"\xca\xfe\xd0\x0d" + body, b"%PDF" + body, b"text", b"B", b""]
    cli = ["jpg", "unknown", "bmp", "gif", "png", "exe", "class", "class", "unknown", "unknown", None, None]
    gui = ["jpg", "jpg", "bmp", "gif", "png", "exe", "class", "unknown", "pdf", "unknown", "unknown", "unknown"]
    assert column(frame, [(r,) for r in rows], "content binary", B.detect_type(C)) == cli
    assert column(frame, [(r,) for r in rows], "content binary", B.detect_type(C, "gui")) == gui


def test_trailer_and_genres(frame):
    tag = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + b"Al\xe9".ljust(30, b"\0") + b"1999" + b"c".ljust(30, b"\0")
    rows = [b"x" * 200 + tag + b"\x07", tag + b"\xc8", tag, b"y" * 300]
    df = frame([(i, r) for i, r in enumerate(rows)], "i int, content binary").select("i", B.id3v1_trailer(C).alias("t"))
    got = genre_lookup(df.select("i", "t.*")).orderBy("i").collect()
    assert [(r.is_tag, r.title, r.artist, r.album, r.year, r.genre) for r in got] == [
        (True, "Title", "Artist", "Al\xe9", "1999", "Hip-Hop"), (True, "Title", "Artist", "Al\xe9", "1999", "Unknown"),
        (False, None, None, None, None, "Unknown"), (False, None, None, None, None, "Unknown"),
    ]
    assert len(GENRES) == 126


def test_dump(frame):
    rng = random.Random(3)
    contents = [rng.randbytes(n) for n in (0, 1, 16, 17, 100)]
    df = frame([(str(i), c) for i, c in enumerate(contents)], "path string, content binary")
    rows = hex_dump(df, base=32).orderBy("path", "row_offset").collect()
    expected = [
        (str(i), 32 + k, f"{32 + k:08X}", [f"{b:02X}" for b in c[k : k + 16]],
         "".join(chr(b) if 0x20 <= b <= 0x7E else "." for b in c[k : k + 16]))
        for i, c in enumerate(contents) for k in range(0, len(c), 16)
    ]
    assert [(r.path, r.row_offset, r.offset, r.hex, r.ascii) for r in rows] == expected
    pieces = blob_chunks(df, chunk=32).orderBy("path", "base").collect()
    assert b"".join(bytes(r.piece) for r in pieces if r.path == "4") == contents[4]


@pytest.mark.parametrize("least", [0, 1, 4])
def test_strings(frame, least):
    rng = random.Random(5)
    contents = [b"", b"abcd", b"\0abc\0abcde\xff", "naïve café\n".encode()]
    contents += [bytes(rng.choice(b"ab\t\n\r ~\x7f\x1f\x80\x00") for _ in range(60)) for _ in range(20)]
    expected = []
    for i, data in enumerate(contents):
        start = None
        for k, byte in enumerate([*data, 0]):
            if 0x20 <= byte <= 0x7E or byte in (9, 10, 13):
                start = k if start is None else start
            elif start is not None:
                if k - start >= least:
                    expected.append((i, start, data[start:k].decode()))
                start = None
    df = frame(list(enumerate(contents)), "i int, content binary")
    assert sorted(map(tuple, scan_strings(df, min_length=least).collect())) == sorted(expected)


def test_strings_filter(frame):
    df = frame([("Alpha",), ("beta",)], "value string")
    assert [r.value for r in strings_filter(df, "ALPH").collect()] == ["Alpha"]
    assert strings_filter(df).count() == 2
    assert tuple(strings_shown(df, "A").first()) == (2, 2) and tuple(strings_shown(df, "l").first()) == (1, 2)


def test_verify_copy(frame):
    schema = "path string, content binary"
    ours = frame([("a", b"text\0\1\2"), ("b", bytes(1 << 20)), ("c", b"x"), ("d", b"")], schema)
    theirs = frame([("a", b"text\0\1\2"), ("b", bytes(1 << 20)), ("c", b"y")], schema)
    assert {r.path: r.identical for r in verify_copy(ours, theirs).collect()} == {"a": True, "b": True, "c": False, "d": False}
