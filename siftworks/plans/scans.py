"""Whole scans: the jobs a user runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions.paths import AUTO_IGNORES, is_binary_ext, is_env_file, path_ignored, path_scan_ignored
from siftworks.functions.rules import Rule, default_rules
from siftworks.operators.coverage import EXCLUDE_FILE, apply_gitignore, is_ignore_file, load_gitignore_rules
from siftworks.operators.delta import delta_lines
from siftworks.operators.findings import as_findings, dedup_findings, file_location
from siftworks.operators.history import scan_history
from siftworks.operators.match import match_rules, scan_text
from siftworks.session import staged
from siftworks.sources.chunks import CHUNK_BYTES, chunk_lines, plan_chunks, read_chunks
from siftworks.sources.readers import decode_text, list_tree, load_ignore_rules, tree_filter
from siftworks.sources.trees import path_exists, with_content


# Longer files are scanned in chunks and not as one value.
WHOLE_BYTES = 1 << 28

# Fixed value: the name of a directory's own scan-ignore file.
IGNORE_FILE = ".fssignore"


@dataclass(frozen=True)
class ScanOptions:
    """Rules, ignores and output choices of a scan.

    ``ignore_file`` is read from the root of a scanned directory and adds to ``scan_ignore``;
    ``global_ignores`` are lines of a user's own version-control ignore file, which hold in every directory scan of a repository.
    """

    rules: Sequence[Rule] = field(default_factory=default_rules)
    ignore: Sequence[str] = ()
    scan_ignore: Sequence[str] = ()
    redact: bool = True
    ignore_file: str | None = IGNORE_FILE
    global_ignores: Sequence[str] = ()

    @property
    def all_ignores(self) -> list[str]:
        return [*self.ignore, *AUTO_IGNORES]


def scan_files(files: DataFrame, options: ScanOptions, *keep: str) -> DataFrame:
    """Findings of text files ``(path, text)``, each with path and line number; binary extensions are skipped."""
    path = F.col("path")
    texts = files.filter(~is_binary_ext(path)).select(*keep, "path", "text")
    matches = scan_text(texts, options.rules, env=is_env_file(path), redact=options.redact)
    return as_findings(matches, file_location(path, F.col("line_no")), *keep)


def scan_large_files(files: DataFrame, options: ScanOptions, *keep: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Findings of listed text files ``(root, path, length)`` of any size, read in chunks; otherwise those of ``scan_files``."""
    path = F.col("path")
    names = ["path", *keep]
    wanted = files.filter(~is_binary_ext(path))
    lines = chunk_lines(read_chunks(plan_chunks(wanted, chunk=chunk)), *names)
    matches = match_rules(lines, options.rules, env=is_env_file(path), redact=options.redact)
    return as_findings(matches, file_location(path, F.col("line_no")), *keep)


def scan_tree(files: DataFrame, options: ScanOptions, *keep: str) -> DataFrame:
    """Findings of a working tree: ignored paths are pruned, then files are scanned."""
    wanted = files.filter(tree_filter(F.col("path"), options.all_ignores, options.scan_ignore))
    return scan_files(wanted, options, *keep)


def delta_wanted(options: ScanOptions) -> Column:
    """Is the path one whose new lines are scanned? As for history, binary extensions are not skipped."""
    path = F.col("path")
    return ~path_ignored(path, options.all_ignores) & ~path_scan_ignored(path, options.scan_ignore, "history")


def scan_added(lines: DataFrame, options: ScanOptions, *extra: str) -> DataFrame:
    """Findings on new lines ``(path, line_no, line, <extra>)``."""
    path = F.col("path")
    trimmed = lines.withColumn("line", F.rtrim("line", F.lit("\r")))
    matches = match_rules(trimmed, options.rules, env=is_env_file(path), redact=options.redact)
    return as_findings(matches, file_location(path, F.col("line_no")), *extra)


def scan_delta(base: DataFrame, new: DataFrame, options: ScanOptions, *, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Findings on lines that are new against a base version, with their new line number."""
    wanted = delta_wanted(options)
    lines = delta_lines(base.filter(wanted), new.filter(wanted), keys=keys)
    return scan_added(lines, options, *[k for k in keys if k != "path"])


def scan_repository(
    files: DataFrame,
    options: ScanOptions,
    *,
    commits: DataFrame | None = None,
    commit_lines: DataFrame | None = None,
) -> DataFrame:
    """Tree findings, then history findings if a log is given, deduplicated and with coverage set.

    ``files(repo, path, text)`` holds the ignore files as well.
    """
    findings = scan_tree(files, options, "repo")
    if commits is not None and commit_lines is not None:
        history = scan_history(
            commits, commit_lines, options.rules,
            ignore=options.all_ignores, scan_ignore=options.scan_ignore, redact=options.redact,
        )
        findings = union_sources(findings, history.drop("commit_pos", "seq"))
    findings = staged(dedup_findings(findings, "repo"), "findings")
    return apply_gitignore(findings, load_gitignore_rules(files))


def union_sources(findings: DataFrame, *others: DataFrame | None) -> DataFrame:
    """Findings of several sources; a source that is None is left out."""
    for other in others:
        if other is not None:
            findings = findings.unionByName(other)
    return findings


def scan_directory(spark: SparkSession, root: str, options: ScanOptions) -> DataFrame:
    """Scan the files below a folder, its own scan-ignore file honoured; if it is a repository, its ignore files decide what is covered."""
    scan_ignore = list(options.scan_ignore)
    if options.ignore_file:
        scan_ignore += load_ignore_rules(spark, f"{root.rstrip('/')}/{options.ignore_file}")
    listing = list_tree(spark, root, ignore=options.all_ignores, scan_ignore=scan_ignore)
    path = F.col("path")
    large = F.col("length") > WHOLE_BYTES
    texts = decode_text(with_content(listing.filter(~is_binary_ext(path) & ~large))).withColumn("repo", F.lit(root))
    findings = scan_files(texts, options, "repo")
    beyond = listing.filter(large).withColumn("repo", F.lit(root))
    if not beyond.isEmpty():
        findings = findings.unionByName(scan_large_files(beyond, options, "repo"))
    if not path_exists(f"{root.rstrip('/')}/.git"):
        return findings.drop("repo")
    exclude = spark.range(1).select(F.lit(root).alias("root"), F.lit(EXCLUDE_FILE).alias("path"), F.lit(0).alias("length"))
    ignore_files = listing.filter(is_ignore_file(path)).select("root", "path", "length").unionByName(exclude)
    rules = load_gitignore_rules(decode_text(with_content(ignore_files)).withColumn("repo", F.lit(root)))
    if options.global_ignores:
        # a file of its own at the root: every ignore file is judged by itself
        own = spark.range(1).select(
            F.lit(root).alias("repo"), F.lit(EXCLUDE_FILE).alias("path"), F.lit("\n".join(options.global_ignores)).alias("text")
        )
        rules = rules.unionByName(load_gitignore_rules(own))
    return apply_gitignore(staged(findings, "findings"), rules).drop("repo")
