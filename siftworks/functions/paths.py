"""Path predicates as column expressions. Paths use ``/`` and are relative to the scanned root."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions treated as binary, and the directory names always ignored.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp",
    "zip", "gz", "tar", "bz2", "xz", "7z", "rar",
    "exe", "dll", "so", "dylib", "bin", "obj", "o", "a",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "mp3", "mp4", "avi", "mov", "wav", "flac",
    "ttf", "otf", "woff", "woff2",
    "pyc", "pyd", "class",
    "lock",
)
AUTO_IGNORES = ("node_modules", ".git", "target", "dist", "__pycache__", ".next", ".venv", "venv")


def _any(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def file_name(path: Column) -> Column:
    """Last component, ignoring trailing ``/`` and ``/.``; NULL for a root, ``.`` or ``..``."""
    name = F.substring_index(F.regexp_replace(path, r"(?:/+\.?)+\z", ""), "/", -1)
    return F.when(~name.isin("", ".", ".."), name)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot; empty when there is no stem before the dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+\.([^.]*)\z", 1))


def is_binary_ext(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def is_env_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return (name == "env") | name.contains(".env")


def path_ignored(path: Column, entries: Iterable[str] = AUTO_IGNORES) -> Column:
    """True where the path equals, lies under, or has a component equal to an entry."""
    entries = [e.rstrip("/") for e in entries]
    names = [e for e in entries if "/" not in e]
    deeper = [e for e in entries if "/" in e]
    conditions = [(path == e) | path.startswith(e + "/") for e in deeper]
    if names:
        components = F.split(path, "/")
        conditions.insert(0, F.arrays_overlap(components, F.array(*[F.lit(n) for n in names])))
    return _any(conditions)


def skip_git_dir(path: Column) -> Column:
    return ~F.array_contains(F.split(path, "/"), ".git")


def scan_ignored(path: Column, pattern: str | Column, mode: str = "tree") -> Column:
    """Match one scan-ignore pattern.

    ``x/`` is a directory prefix anchored at the root; anything else matches the
    path itself or a ``/x`` suffix.  A tree scan prunes matched directories, so
    there every ancestor is tested as well, which for a suffix match means that
    the pattern occurs as whole components anywhere in the path.
    """
    if mode not in ("tree", "history"):
        raise ValueError(f"mode must be tree or history, not {mode!r}")
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    as_prefix = F.startswith(norm, F.concat(F.rtrim(pattern, F.lit("/")), F.lit("/")))
    if mode == "tree":
        as_suffix = F.contains(F.concat(F.lit("/"), norm, F.lit("/")), F.concat(F.lit("/"), pattern, F.lit("/")))
    else:
        as_suffix = (norm == pattern) | F.endswith(norm, F.concat(F.lit("/"), pattern))
    return F.when(F.endswith(pattern, F.lit("/")), as_prefix).otherwise(as_suffix)


def path_scan_ignored(path: Column, patterns: Iterable[str], mode: str = "tree") -> Column:
    """True where any scan-ignore pattern matches; ``patterns`` become literals in the plan."""
    return _any(scan_ignored(path, p.strip(), mode) for p in patterns)


def dest_path(path: Column, dest: str | Column) -> Column:
    """``dest / basename``; directories are flattened, a nameless path becomes ``unknown``."""
    dest = F.lit(dest) if isinstance(dest, str) else dest
    return F.concat(F.rtrim(dest, F.lit("/")), F.lit("/"), F.coalesce(file_name(path), F.lit("unknown")))


def path_depth_ok(path: Column, target: str, recursive: bool) -> Column:
    """Is ``path`` the target itself or below it: anywhere below, or directly below when shallow."""
    target = target.rstrip("/")
    below = path.startswith(target + "/")
    if not recursive:
        below = below & ~F.contains(F.substring(path, len(target) + 2, 1 << 30), F.lit("/"))
    return (path == target) | below
