"""Scanning the added lines of an exported commit log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions.paths import AUTO_IGNORES, is_env_file, path_ignored, path_scan_ignored
from siftworks.functions.rules import Rule
from siftworks.operators.findings import as_findings, commit_location
from siftworks.operators.match import match_rules
from siftworks.operators.ranking import ranked


def walk_order(commits: DataFrame) -> DataFrame:
    """Newest first: ``commit_pos`` is the position in the exporter's walk by time and topology."""
    return commits.orderBy("repo", "commit_pos")


def walk_rank(commits: DataFrame) -> DataFrame:
    """``walk_order`` as a column: the 1-based ``rank`` of a commit in its repository, for results that are not kept in order."""
    return ranked(commits, ["repo"], F.floor(F.col("commit_pos") / F.lit(1 << 16)), ["commit_pos", "hash"])


def skip_merges(commits: DataFrame) -> DataFrame:
    return commits.filter(F.col("parent_count") <= 1)


def added_only(commit_lines: DataFrame) -> DataFrame:
    """Added lines that are valid UTF-8, tested per line; only ``\\n`` is cut, a ``\\r`` stays."""
    text = F.col("content").cast("string")
    added = commit_lines.filter((F.col("origin") == "+") & F.is_valid_utf8(text))
    return added.withColumn("content", F.rtrim(text, F.lit("\n")))


def history_lines(commits: DataFrame, commit_lines: DataFrame) -> DataFrame:
    """Every added line of every non-merge commit, with the commit's data."""
    return added_only(commit_lines).join(skip_merges(commits), ["repo", "hash"])


def scan_history(
    commits: DataFrame,
    commit_lines: DataFrame,
    rules: Sequence[Rule],
    *,
    ignore: Iterable[str] = AUTO_IGNORES,
    scan_ignore: Iterable[str] = (),
    redact: bool = True,
    dedup: bool = True,
) -> DataFrame:
    """Findings of a commit log.

    Lines are matched where they are read and only the few matches are joined
    with their commits, so the log itself is never shuffled and a commit that
    holds a large share of it is no bottleneck.
    """
    file = F.col("file")
    lines = added_only(commit_lines).filter(
        ~path_ignored(file, list(ignore)) & ~path_scan_ignored(file, list(scan_ignore), "history")
    )
    matches = match_rules(
        lines.select("repo", "hash", "file", "seq", "content"), rules, line="content", env=is_env_file(file), redact=redact
    )
    found = matches.join(skip_merges(commits), ["repo", "hash"])
    location = commit_location(F.col("hash"), F.col("file"), F.col("summary"))
    findings = as_findings(found, location, "repo", "commit_pos", "seq")
    return history_dedup(findings) if dedup else findings


def history_dedup(findings: DataFrame, order: Column | None = None) -> DataFrame:
    """First finding in walk order per (repo, rule, file, matched text as shown).

    An aggregate, not a window: duplicates are reduced before the shuffle, so a
    token repeated throughout the history costs one row per task.
    """
    order = F.struct("commit_pos", "seq") if order is None else order
    keyed = findings.withColumn("_file", F.col("location.file"))
    keys = ["repo", "rule_name", "_file", "matched_text"]
    rest = [c for c in findings.columns if c not in keys]
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    unpacked = [F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in findings.columns]
    return first.select(*unpacked)
