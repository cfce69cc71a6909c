"""Text expressions: white space, case folding and line splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def trim_both(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def fold(text: Column) -> Column:
    """Case-fold so that an ASCII literal found case-insensitively is also found by ``contains``.

    Besides A-Z only the long s and the Kelvin sign fold to ASCII; ``lower`` maps the latter itself.
    """
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def split_lines(text: Column) -> Column:
    """Array of lines: ``\\n`` or ``\\r\\n`` ends a line, a bare ``\\r`` stays, an empty tail is no line.

    The final line break is cut first; the regex split runs only on texts that contain ``\\r``.
    """
    length = F.length(text)
    body = (
        F.when(F.endswith(text, F.lit("\r\n")), F.left(text, length - 2))
        .when(F.endswith(text, F.lit("\n")), F.left(text, length - 1))
        .otherwise(text)
    )
    parts = F.when(F.contains(text, F.lit("\r")), F.split(body, "\r?\n")).otherwise(F.split(body, "\n"))
    return F.when(text != "", parts)


def decode_utf8(content: Column) -> Column:
    """Binary to text; NULL where the bytes are not wholly valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)
