"""Rule patterns are written in the linear-time regex dialect the rules were
published in; Spark evaluates ``java.util.regex``.  ``to_java`` bridges the two.

Differences that matter for results:

* Unicode classes and case folding are on by default there, off in Java: ``(?U)``.
* only ``\\n`` ends a line for ``.`` there: ``(?d)``.
* ``$`` is the end of the text there, but in Java it also matches before a final
  line break: ``\\z``, unless the pattern asks for multi-line mode.
* named groups are spelled ``(?P<name>...)`` there.
* Java folds dotless and dotted Turkish i to ``i``, that dialect does not: in patterns that start with ``(?i)``
  the letter i and character classes are spelled out in both cases and matched as they are.

Constructs the linear-time dialect rejects (look-around, back-references, atomic
groups, ``\\Q``/``\\G``/``\\R``/``\\X``/``\\Z``) are refused, so that a custom rule
means the same thing in both.
"""

from __future__ import annotations

import re

FLAGS = "(?dU)"

_REFUSED_GROUP = re.compile(r"\(\?(?:=|!|<=|<!|>)")
_REFUSED_ESCAPES = "123456789kQEGRXZ"
_FLAG_GROUP = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?[):]")


def _is_multiline(pattern: str) -> bool:
    return any("m" in m.group(1) for m in _FLAG_GROUP.finditer(pattern))


_RANGE = re.compile(r"\\.|(.)-([^\]\\])|[^\\]", re.DOTALL)
# Letters beyond ASCII that fold to an ASCII letter in the linear dialect.
_FOLD_TO = {"s": "\u017f", "k": "\u212a"}


def _both_cases(content: str) -> str:
    """The content of a character class with the other case of its ASCII letters."""
    extra: dict[str, None] = {}
    for part in _RANGE.finditer(content):
        if part[1]:
            letters = [chr(c) for c in range(ord(part[1]), ord(part[2]) + 1) if chr(c).isascii() and chr(c).isalpha()]
        else:
            letters = [part[0]] if part[0].isascii() and part[0].isalpha() else []
        if len(letters) > 1 and (part[1] + part[2]).isalpha() and part[1].isupper() == part[2].isupper():
            extra[f"{part[1].swapcase()}-{part[2].swapcase()}"] = None
        else:
            extra.update(dict.fromkeys(c.swapcase() for c in letters))
        extra.update({_FOLD_TO[c.lower()]: None for c in letters if c.lower() in _FOLD_TO})
    return content + "".join(extra)


def _in_group_name(pattern: str, i: int) -> bool:
    """Is the letter at ``i`` part of a flag group, a group's name or a property's name?"""
    return bool(re.search(r"(?:\(\?[a-zA-Z-]*|\(\?P?<[^>]*|\\[pP]\{[^}]*)\Z", pattern[:i]))


def _class_end(pattern: str, start: int) -> int:
    """The place of the bracket that closes a simple class opened at ``start``; -1 if it nests or intersects."""
    i = start + 1 + pattern.startswith("[^", start)
    first = i
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "]" and i > first:
            return i
        elif pattern[i] == "[" or pattern.startswith("&&", i):
            return -1
        else:
            i += 1
    return -1


def to_java(pattern: str) -> str:
    """Translate a rule pattern to a Java pattern; ``ValueError`` if it uses an unsupported construct."""
    multiline = _is_multiline(pattern)
    folded = pattern.startswith("(?i)")
    out: list[str] = []
    depth = 0  # nesting of character classes
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"invalid pattern {pattern!r}: trailing backslash")
            if pattern[i + 1] in _REFUSED_ESCAPES:
                raise ValueError(f"invalid pattern {pattern!r}: \\{pattern[i + 1]} is not supported")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if folded and ch in "iI" and not depth and not _in_group_name(pattern, i):
            out.append("(?-i:[iI])")
            i += 1
            continue
        if folded and ch == "[" and not depth and (end := _class_end(pattern, i)) > 0:
            content = pattern[i + 1 : end]
            sign = "^" if content.startswith("^") else ""
            out.append(f"(?-i:[{sign}{_both_cases(content.removeprefix('^'))}])")
            i = end + 1
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
        elif ch == "$" and not depth and not multiline:
            ch = r"\z"
        elif ch == "(" and not depth:
            if _REFUSED_GROUP.match(pattern, i):
                raise ValueError(f"invalid pattern {pattern!r}: look-around and atomic groups are not supported")
            flags = _FLAG_GROUP.match(pattern, i)
            if flags and "U" in flags.group(1):
                raise ValueError(f"invalid pattern {pattern!r}: flag U is not supported")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
        out.append(ch)
        i += 1
    return FLAGS + "".join(out)


def first_match_prefix(lead: str, core: str) -> str:
    """A pattern whose group 1 is all text before the first match of ``core``, led up to by ``lead``.

    Anchored at the start, so a replace touches exactly the first match, and no
    character position (UTF-16 in Java, code points in Spark) has to be computed.
    """
    return FLAGS + r"\A((?s:.*?)" + lead.removeprefix(FLAGS) + ")(?:" + core + ")"
