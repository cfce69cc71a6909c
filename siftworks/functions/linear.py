"""Which patterns a backtracking engine should not run, and the same patterns for the linear-time engine in Arrow.

Java's engine runs a repeated group by recursion, one frame for each round, so a long line overflows the stack and takes the
executor with it; and a pattern that begins with a repeat is tried again from every later place in the same stretch of
text. Whether a rule goes the linear way follows from its pattern alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

_UNBOUNDED = re.compile(r"(?:[*+]|\{\d+,\}|\{(?:\d+,)?\d{3,}\})")
_FLAGS = re.compile(r"\(\?[a-zA-Z-]+\)")
_ATOM = re.compile(r"\\[pP]\{[^}]*\}|\\x\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[^\\\[\](){}*+?|^$]", re.DOTALL)

# Classes that mean all of Unicode in the rules' dialect and ASCII in the linear engine; the letters that are neither
# L, M nor Nl are the circled and squared ones.
_DIGIT, _SPACE = r"\p{Nd}", r"\t-\r\x{85}\p{Z}"
_WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\x{200C}\x{200D}"
_CLASSES = {"d": _DIGIT, "s": _SPACE, "w": _WORD}


def needs_linear_time(pattern: str) -> bool:
    """Does the pattern repeat a group without a small bound, or begin with an unbounded repeat?"""
    in_class, i = False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            i += pattern.startswith("^]", i + 1) * 2 or pattern.startswith("]", i + 1)
        elif ch == ")" and _UNBOUNDED.match(pattern, i + 1):
            return True
        i += 1
    body = _FLAGS.sub("", pattern, count=1) if _FLAGS.match(pattern) else pattern
    first = _ATOM.match(body)
    return bool(first and _UNBOUNDED.match(body, first.end()))


def to_linear(pattern: str) -> str | None:
    """The pattern for the linear engine, its groups without captures; None if that engine cannot say the same."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch, after = pattern[i], pattern[i + 1 : i + 2]
        if ch == "\\":
            if after in "bBuUNX" or not after:
                return None
            inside = _CLASSES.get(after.lower())
            if inside is None:
                end = pattern.find("}", i) + 1 if after in "pPx" and pattern.startswith("{", i + 2) else i + 2
                out.append(pattern[i:end])
                i = end
                continue
            if after.isupper() and in_class:
                return None  # the complement of a class within a class
            out.append(inside if in_class else f"[{'^' if after.isupper() else ''}{inside}]")
            i += 2
            continue
        if in_class:
            if ch == "[" or pattern.startswith(("&&", "--", "~~"), i):
                return None  # nested classes and operations on classes
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(head)
            i += len(head)
            continue
        elif ch == "(":
            named = re.match(r"\(\?P?<[^>]*>", pattern[i:])
            out.append("(?:" if named or after != "?" else "(")
            i += len(named[0]) if named else 1
            continue
        out.append(ch)
        i += 1
    linear = "".join(out)
    try:
        pc.extract_regex(pa.array([""]), parts_pattern(linear))
    except pa.ArrowInvalid:
        return None
    return linear


def parts_pattern(linear: str) -> str:
    """What stands before the first match, the match, and the rest."""
    return rf"\A(?P<before>(?s:.*?))(?P<hit>(?:{linear}))(?P<rest>(?s:.*))\z"


def first_matches(lines: pa.Array, linear: str, allowlist: str | None = None) -> tuple[pa.Array, pa.StructArray]:
    """Rows on which the pattern matches and the allowlist does not, and the parts of those lines."""
    hit = pc.fill_null(pc.match_substring_regex(lines, linear), False)
    if allowlist is not None:
        hit = pc.and_not(hit, pc.fill_null(pc.match_substring_regex(lines, allowlist), False))
    rows = pc.indices_nonzero(hit)
    return rows, pc.extract_regex(lines.take(rows), parts_pattern(linear))
