"""Byte expressions over a BINARY column.

Two dialects exist where the command-line tool and the desktop viewer disagree;
``dialect="cli"`` or ``"gui"`` picks one.  Offsets are 0-based LONG columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftworks.functions.text import trim_both

# Leading bytes of file types (in order of precedence), the bytes a
# JPEG ends with, and the size of a hex row and of a page.
MAGIC_CLI = (("png", ("89504E47",)), ("gif", ("47494638",)), ("bmp", ("424D",)), ("exe", ("4D5A",)),
             ("class", ("CAFEBABE", "CAFED00D")))
MAGIC_GUI = (("jpg", ("FFD8",)), ("png", ("89504E47",)), ("gif", ("47494638",)), ("bmp", ("424D",)),
             ("exe", ("4D5A",)), ("class", ("CAFEBABE",)), ("pdf", ("25504446",)))
JPEG_START, JPEG_END = "FFD8", "FFD9"
ROW_BYTES = 16
PAGE_BYTES = 512
LATIN1 = "ISO-8859-1"
I64_MAX = 9223372036854775807


def _dialect(dialect: str) -> bool:
    if dialect not in ("cli", "gui"):
        raise ValueError(f"dialect must be cli or gui, not {dialect!r}")
    return dialect == "cli"


def _long(value: Column | int) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) else value


def _flag(value: Column | bool) -> Column:
    return F.lit(value) if isinstance(value, bool) else value


# No value is longer; a result that would be is NULL, with an error where the form has one.
MOST_BYTES = 2**31 - 16

# Error texts.
SHORT_BUFFER = "failed to fill whole buffer"
PAST_END = "Offset past EOF; use append_zero_past_eof flag"
WRONG_LENGTH = "Data length (%d) must match range length (%d) for overwrite"
ODD_DIGITS = "hex bytes must have an even number of hex digits"
NO_DIGITS = "no hex bytes provided"
AT_END = (" is at or past EOF (", ")")

TOO_LONG = "the result does not fit one value"


def size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def cut(content: Column, start: Column, count: Column) -> Column:
    """``count`` bytes from ``start``; empty outside the content."""
    n = size(content)
    first = F.least(F.greatest(start, F.lit(0)), n)
    return F.substring(content, (first + 1).cast("int"), F.least(F.greatest(count, F.lit(0)), n).cast("int"))


def head(content: Column, count: Column) -> Column:
    return cut(content, F.lit(0).cast("long"), count)


def tail(content: Column, start: Column) -> Column:
    return cut(content, start, size(content))


def pad_to(content: Column, length: Column) -> Column:
    """Zero bytes appended up to ``length``; never shortened. NULL beyond ``MOST_BYTES``."""
    wanted = F.least(F.greatest(length, size(content)), F.lit(MOST_BYTES)).cast("int")
    return F.when(length <= MOST_BYTES, F.rpad(content, wanted, F.lit(b"\x00")))


def reverse_bytes(content: Column) -> Column:
    return F.encode(F.reverse(F.decode(content, LATIN1)), LATIN1)


def parse_int_auto(text: Column, dialect: str = "cli", unsigned: bool = False) -> Column:
    """Trimmed decimal or ``0x`` / ``-0x`` number as LONG; NULL where it does not parse.

    The viewer reads like JavaScript's ``parseInt``: leading digits count, the rest is ignored.
    """
    word = trim_both(text)
    strict = _dialect(dialect)
    end = r"\z" if strict else ""
    prefix = r"\A" if unsigned else r"\A-?"
    inner = r"\+?" if unsigned or not strict else r"[+-]?"
    hex_form = f"{prefix}0[xX]({inner})([0-9a-fA-F]+){end}"
    digits = F.regexp_extract(word, hex_form, 2)
    # more than 16 digits never fit, and conv would raise on them
    significant = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    magnitude = F.when(F.length(significant) <= 16, F.conv(significant, 16, 10)).try_cast("long")
    negative = F.startswith(word, F.lit("-")) != (F.regexp_extract(word, hex_form, 1) == "-")
    sign = r"\+?" if unsigned else r"[+-]?"
    decimal = F.regexp_extract(word, rf"\A({sign}[0-9]+){end}", 1)
    is_hex = word.rlike(r"\A-?0[xX]")
    return F.when(is_hex, F.when(digits != "", F.when(negative, -magnitude).otherwise(magnitude))).otherwise(
        F.when(decimal != "", decimal.try_cast("long"))
    )


def resolve_offset(offset: Column | int, length: Column) -> Column:
    """A negative offset counts back from the end, floored at 0."""
    offset = _long(offset)
    return F.when(offset < 0, F.greatest(length + offset, F.lit(0))).otherwise(offset)


def byte_range(content: Column, start: Column | int, end: Column | int | None, dialect: str = "cli") -> Column:
    """Bytes from ``start`` to ``end`` inclusive; ``end`` None reads to the end of the content.

    cli: a binary, empty for an invalid range; a numeric end past the content reads to its end.
    gui: a struct ``(bytes, error)``; offsets are clamped at 0 and an end past the content is an error.
    """
    n = size(content)
    start = _long(start)
    nothing = F.lit(b"")
    if _dialect(dialect):
        if end is None:
            return tail(content, resolve_offset(start, n))
        end = _long(end)
        first = F.when(start < 0, n + start).otherwise(start)
        last = F.when(end < 0, n + end).otherwise(end)
        return F.when((first >= 0) & (last >= first), cut(content, first, F.least(last, n) - F.least(first, n) + 1)).otherwise(
            nothing
        )
    first = resolve_offset(start, n)
    to_end = F.greatest(n - 1, F.lit(0))
    if end is None:
        last = to_end
    else:
        end = _long(end)
        last = F.when(end == I64_MAX, to_end).otherwise(resolve_offset(end, n))
    empty = (first > last) | (first >= n)
    failed = ~empty & (last >= n)
    data = F.when(empty, nothing).when(~failed, cut(content, first, F.least(last, n) - F.least(first, n) + 1))
    return F.struct(data.alias("bytes"), F.when(failed, F.lit(SHORT_BUFFER)).alias("error"))


def byte_page(content: Column, offset: Column | int, page: int = PAGE_BYTES) -> Column:
    """The page of bytes starting at an offset, clamped to the content."""
    first = F.greatest(_long(offset), F.lit(0))
    return cut(content, first, F.lit(page).cast("long"))


def read_bytes_padded(content: Column, offset: Column | int, count: int) -> Column:
    return pad_to(cut(content, _long(offset), F.lit(count).cast("long")), F.lit(count).cast("long"))


def hex_cells(content: Column, prefix: bool = False) -> Column:
    """Lower-case two-digit cells joined by spaces, each with ``0x`` if ``prefix``."""
    pairs = F.lower(F.hex(content))
    if prefix:
        return F.regexp_replace(F.regexp_replace(pairs, "(..)", "0x$1 "), r" \z", "")
    return F.regexp_replace(pairs, "(..)(?=.)", "$1 ")


def header4(content: Column) -> Column:
    """The first four bytes as ``0x..`` cells, NULL for shorter content."""
    return F.when(size(content) >= 4, hex_cells(F.substring(content, 1, 4), prefix=True))


def _by_magic(lead: Column, table: tuple[tuple[str, tuple[str, ...]], ...], found: Column | None = None) -> Column:
    for kind, magics in table:
        for magic in magics:
            test = F.startswith(lead, F.lit(magic))
            found = F.when(test, F.lit(kind)) if found is None else found.when(test, F.lit(kind))
    return found.otherwise(F.lit("unknown"))


def detect_type(content: Column, dialect: str = "cli") -> Column:
    """File type by leading bytes.

    cli: a JPEG must also end with its end marker; content under two bytes gives NULL.
    gui: knows PDF, only one class marker, and calls short content unknown.
    """
    n = size(content)
    lead = F.hex(F.substring(content, 1, 4))
    if _dialect(dialect):
        last_two = F.hex(tail(content, n - 2))
        jpeg = F.when(F.startswith(lead, F.lit(JPEG_START)) & (last_two == JPEG_END), F.lit("jpg"))
        return F.when(n >= 2, _by_magic(lead, MAGIC_CLI, jpeg))
    return F.when(n < 2, F.lit("unknown")).otherwise(_by_magic(lead, MAGIC_GUI))


def payload(content: Column, offset: Column | int | None = None) -> Column:
    """Write data taken from another blob, optionally from a byte offset; empty past its end."""
    if offset is None:
        return content
    offset = _long(offset)
    return F.when(offset.isNull(), content).otherwise(tail(content, offset))


def _oriented(data: Column, turned: Column) -> Column:
    return F.when(turned, reverse_bytes(data)).otherwise(data)


def _result(content: Column, error: Column) -> Column:
    too_long = F.when(content.isNull(), F.lit(TOO_LONG))
    return F.struct(F.when(error.isNull(), content).alias("content"), F.coalesce(error, too_long).alias("error"))


def append_eof(content: Column, data: Column, reverse: Column | bool = False) -> Column:
    return F.concat(content, _oriented(data, _flag(reverse)))


def overwrite_at(
    content: Column,
    offset: Column | int,
    data: Column,
    *,
    append_zero: Column | bool = False,
    reverse: Column | bool = False,
    dialect: str = "cli",
) -> Column:
    """Overwrite from an offset.

    cli (binary): cut at the end unless ``append_zero``; at the end data is
    appended; past the end only ``append_zero`` writes, after zero padding.
    gui (struct ``content, error``): always cut at the end; past the end is an
    error unless ``append_zero``.
    """
    n, append_zero = size(content), _flag(append_zero)
    at = resolve_offset(offset, n)
    data = _oriented(data, _flag(reverse))
    fits = F.least(size(data), n - at)
    inside = F.concat(head(content, at), head(data, fits), tail(content, at + fits))
    padded = F.concat(pad_to(content, at), data)
    if _dialect(dialect):
        return (
            F.when((at < n) & append_zero, F.concat(inside, tail(data, fits)))
            .when(at < n, inside)
            .when((at == n) | append_zero, padded)
            .otherwise(content)
        )
    past = (at > n) & ~append_zero
    error = F.when(past, F.lit(PAST_END))
    return _result(F.when(at > n, padded).otherwise(inside), error)


def overwrite_range(
    content: Column,
    first: Column | int,
    second: Column | int,
    data: Column,
    *,
    append_zero: Column | bool = False,
    reverse: Column | bool = False,
    dialect: str = "cli",
) -> Column:
    """Overwrite a range with data of exactly its length.

    cli (binary): the range excludes its end; a wrong length changes nothing; a
    descending range or ``reverse`` turns the data once; bytes past the end are
    dropped and, with ``append_zero``, replaced by zeros.
    gui (struct): the range includes its end; a wrong length is an error;
    descending and ``reverse`` each turn the data; the content grows if needed.
    """
    n = size(content)
    one, two = resolve_offset(first, n), resolve_offset(second, n)
    # no offset beyond this can be reached, and sums of two stay in range
    low, high = F.least(one, two, F.lit(I64_MAX // 2)), F.least(F.greatest(one, two), F.lit(I64_MAX // 2))
    descending, reverse = one > two, _flag(reverse)
    if _dialect(dialect):
        turned = _oriented(data, descending | reverse)
        written = F.concat(head(content, low), head(turned, n - low), tail(content, high))
        grown = F.when(_flag(append_zero), pad_to(written, high)).otherwise(written)
        return F.when(size(data) == high - low, grown).otherwise(content)
    turned = _oriented(data, descending != reverse)
    length = high - low + 1
    written = F.concat(pad_to(head(content, low), low), turned, tail(content, high + 1))
    error = F.when(
        size(data) != length,
        F.format_string(WRONG_LENGTH, size(data), length),
    )
    return _result(written, error)


def insert_at(
    content: Column, offset: Column | int, data: Column, *, reverse: Column | bool = False, dialect: str = "cli"
) -> Column:
    """Insert, shifting the rest right. Past the end the cli pads with zeros, the gui inserts at the end."""
    n = size(content)
    at = resolve_offset(offset, n)
    data = _oriented(data, _flag(reverse))
    if _dialect(dialect):
        inserted = F.concat(pad_to(head(content, at), at), data, tail(content, at))
        return F.when(size(data) == 0, content).otherwise(inserted)
    at = F.least(at, n)
    return F.concat(head(content, at), data, tail(content, at))


def insert_range(
    content: Column, first: Column | int, second: Column | int, data: Column, *, reverse: Column | bool = False
) -> Column:
    """Insert at the lower of two offsets; a descending pair or ``reverse`` turns the data."""
    n = size(content)
    one, two = resolve_offset(first, n), resolve_offset(second, n)
    at = F.least(one, two)
    data = _oriented(data, (one > two) | _flag(reverse))
    return F.concat(pad_to(head(content, at), at), data, tail(content, at))


def clean_hex(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Fa-f]", "")


def patch_hex(content: Column, offset: Column | int, hex_text: Column) -> Column:
    """Overwrite with bytes typed as hex: struct ``(content, bytes_written, start, error)``."""
    n = size(content)
    digits = clean_hex(hex_text)
    offset = _long(offset)
    at = resolve_offset(offset, n)
    error = (
        F.when(F.length(digits) % 2 != 0, F.lit(ODD_DIGITS))
        .when(digits == "", F.lit(NO_DIGITS))
        .when(offset.isNull(), F.lit("invalid offset"))
        .when(at >= n, F.concat(F.lit("offset 0x"), F.hex(at), F.lit(AT_END[0]), n.cast("string"), F.lit(AT_END[1])))
    )
    data = F.unhex(digits)
    fits = F.least(size(data), n - at)
    ok = error.isNull()
    patched = F.concat(head(content, at), head(data, fits), tail(content, at + fits))
    return F.struct(
        F.when(ok, patched).alias("content"),
        F.when(ok, fits).alias("bytes_written"),
        F.when(ok, at).alias("start"),
        error.alias("error"),
    )


def parse_hex_byte(text: Column) -> Column:
    """A typed cell to a byte 0..255 from its first two hex digits; NULL when there are none."""
    digits = F.substring(clean_hex(text), 1, 2)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("smallint"))


def id3v1_trailer(content: Column) -> Column:
    """The last 128 bytes cut into the fields of a tag; ``is_tag`` says whether it is one."""
    block = tail(content, size(content) - 128)

    def field(start: int, count: int) -> Column:
        text = F.decode(F.substring(block, start + 1, count), LATIN1)
        return F.rtrim(F.regexp_extract(text, r"(?s)\A([^\x00]*)", 1))

    is_tag = (size(block) == 128) & (F.hex(F.substring(block, 1, 3)) == "544147")
    return F.struct(
        is_tag.alias("is_tag"),
        F.when(is_tag, field(3, 30)).alias("title"),
        F.when(is_tag, field(33, 30)).alias("artist"),
        F.when(is_tag, field(63, 30)).alias("album"),
        F.when(is_tag, field(93, 4)).alias("year"),
        F.when(is_tag, field(97, 30)).alias("comment"),
        F.when(is_tag, F.conv(F.hex(F.substring(block, 128, 1)), 16, 10).cast("int")).alias("genre_code"),
    )
