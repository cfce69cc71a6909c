"""Sources: file trees, ignore files, inventories and event tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions.paths import (
    AUTO_IGNORES,
    is_binary_ext,
    path_ignored,
    path_scan_ignored,
    scan_ignored,
    skip_git_dir,
)
from siftworks.functions.text import decode_utf8, split_lines, trim_both
from siftworks.session import staged
from siftworks.sources.trees import walk_tree, with_content


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``; the reader reports absolute URIs whose scheme may be spelled differently."""
    marker = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, marker, -1) if marker == "/" else F.element_at(F.split(path, r"\Q" + marker + r"\E", 2), 2)


def binary_files(spark: SparkSession, root: str, *, recursive: bool = True, name_glob: str | None = None) -> DataFrame:
    """Blobs ``(root, path, content, length, modificationTime)`` below ``root``, paths relative to it.

    Columns that are not used later are not read: an inventory never opens a file.
    Spark's reader leaves out hidden files; ``read_tree`` finds them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(root)
    return files.select(
        F.lit(root).alias("root"), _relative(F.col("path"), root).alias("path"), "content", "length", "modificationTime"
    )


def list_tree(
    spark: SparkSession,
    root: str,
    *,
    ignore: Iterable[str] = AUTO_IGNORES,
    scan_ignore: Iterable[str] = (),
) -> DataFrame:
    """The files a tree scan looks at, hidden ones included; ignored directories are not entered."""
    return walk_tree(spark, root, tree_filter(F.col("path"), ignore, scan_ignore))


def read_tree(spark: SparkSession, root: str, **ignores: Iterable[str]) -> DataFrame:
    """``list_tree`` with the contents of the files."""
    return with_content(list_tree(spark, root, **ignores))


def tree_filter(path: Column, ignore: Iterable[str] = AUTO_IGNORES, scan_ignore: Iterable[str] = ()) -> Column:
    """Is a file looked at by a tree scan?"""
    return skip_git_dir(path) & ~path_ignored(path, list(ignore)) & ~path_scan_ignored(path, list(scan_ignore), "tree")


def decode_text(files: DataFrame, *, content: str = "content") -> DataFrame:
    """Text files only: content as ``text``; files with a binary extension or invalid UTF-8 drop out."""
    texts = files.filter(~is_binary_ext(F.col("path"))).withColumn("text", decode_utf8(F.col(content)))
    return texts.filter(F.col("text").isNotNull()).drop(content)


def load_ignore_rules(spark: SparkSession, path: str) -> list[str]:
    """Patterns of one scan-ignore file: trimmed, without blanks and ``#`` comments; none if it is missing.

    The patterns of a root become literals of the scan, so this one small file is read by the driver.
    """
    folder, _, name = path.rpartition("/")
    one = spark.range(1).select(F.lit(folder or "/").alias("root"), F.lit(name).alias("path"), F.lit(0).alias("length"))
    # Spark's own readers leave out files whose name starts with a dot
    lines = decode_text(with_content(one)).select(F.explode(split_lines(F.col("text"))).alias("value"))
    pattern = trim_both(F.col("value"))
    rows = lines.select(pattern.alias("p")).filter((F.col("p") != "") & ~F.startswith("p", F.lit("#"))).collect()
    return [r.p for r in rows]


def ignore_rules_by_root(files: DataFrame, name: str) -> DataFrame:
    """Scan-ignore files among ``files(root, path, text)`` as one row ``(root, patterns)`` each."""
    cleaned = F.transform(F.coalesce(split_lines(F.col("text")), F.array()), trim_both)
    kept = F.filter(cleaned, lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    return files.filter(F.col("path") == name).select("root", kept.alias("patterns"))


def _path_keys(path: Column, mode: str, prefixes: Sequence[int], runs: Sequence[int]) -> Column:
    """Hashes of the leading folders of a path, and of runs of its components, by number of components.

    In a tree a run may stand anywhere, as matched folders are pruned; else it ends the path.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    depth = F.size(parts)

    def some(kind: str, n: int, first: Column | int, last: Column) -> Column:
        starts = F.sequence(F.lit(first) if isinstance(first, int) else first, last)
        keys = F.transform(starts, lambda i: F.xxhash64(F.lit(kind), F.array_join(F.slice(parts, i, n), "/")))
        return F.when(depth >= n + (kind == "prefix"), keys).otherwise(F.array().cast("array<bigint>"))

    found = [some("prefix", n, 1, F.lit(1)) for n in prefixes]
    found += [some("run", n, 1 if mode == "tree" else depth - n + 1, depth - n + 1) for n in runs]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<bigint>")


def paths_anti_ignores(files: DataFrame, rules: DataFrame, mode: str = "tree") -> DataFrame:
    """Files not matched by any pattern of their own root, from ``rules(root, patterns)``.

    Paths and patterns meet by root and hash of the components in question, so a path meets the patterns
    that match it and not all of its root, and a root with very many of both is dealt over all tasks. Only
    lengths that occur among the patterns are tried; there are no more of them than a path has components.
    """
    folder = F.endswith("pattern", F.lit("/"))
    patterns = rules.select("root", F.explode("patterns").alias("pattern")).distinct()
    kind, name = F.when(folder, F.lit("prefix")).otherwise(F.lit("run")), F.when(folder, F.rtrim("pattern", F.lit("/"))).otherwise(F.col("pattern"))
    facts = patterns.select("root", "pattern", kind.alias("_kind"), F.size(F.split(name, "/")).alias("_n"), F.xxhash64(kind, name).alias("_key"))
    named = staged(facts, "patterns")
    lengths = [(r["_kind"], r["_n"]) for r in named.select("_kind", "_n").distinct().collect()]
    prefixes, runs = (sorted(n for kind, n in lengths if kind == wanted) for wanted in ("prefix", "run"))
    paths = files.select("root", "path").distinct()
    keyed = paths.select("root", "path", F.explode(_path_keys(F.col("path"), mode, prefixes, runs)).alias("_key"))
    # a hash may err, the test does not
    met = keyed.join(named.select("root", "_key", "pattern"), ["root", "_key"])
    ignored = met.where(scan_ignored(F.col("path"), F.col("pattern"), mode)).select("root", "path").distinct()
    return files.join(ignored, ["root", "path"], "left_anti").select(*files.columns)


def manifest(files: DataFrame) -> DataFrame:
    """Size and modification time per path, of a listing or of blobs; contents are not read."""
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def inventory(files: DataFrame) -> DataFrame:
    """Manifest with digests, as compared by ``manifest_diff``; reads every file."""
    return files.select(
        "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")
    )
