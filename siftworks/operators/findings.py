"""The findings relation: shaping, filtering, deduplication, counting and output rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions.severity import parse_severity, rank_of

FINDING_COLUMNS = (
    "rule_name", "severity", "severity_rank", "location", "matched_text", "line_content", "git_ignored",
)


def _location(**fields: Column) -> Column:
    types = {
        "source": "string", "path": "string", "line_no": "int",
        "hash": "string", "short_hash": "string", "file": "string", "commit_message": "string",
    }
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()])


def file_location(path: Column, line_no: Column) -> Column:
    return _location(source=F.lit("file"), path=path, line_no=line_no)


def commit_location(commit_hash: Column, file: Column, summary: Column) -> Column:
    return _location(
        source=F.lit("commit"),
        hash=commit_hash,
        short_hash=short_hash(commit_hash),
        file=file,
        commit_message=commit_summary(summary),
    )


def short_hash(commit_hash: Column) -> Column:
    return F.substring(commit_hash, 1, 8)


def commit_summary(summary: Column) -> Column:
    return F.coalesce(summary, F.lit(""))


def as_findings(matches: DataFrame, location: Column, *keep: str) -> DataFrame:
    """Matches to findings; ``keep`` names further columns to carry along."""
    return matches.select(
        *keep,
        "rule_name",
        "severity",
        "severity_rank",
        location.alias("location"),
        "matched_text",
        "line_content",
        F.lit(False).alias("git_ignored"),
    )


def loc_key(location: Column) -> Column:
    """``file:path:line`` or ``commit:hash:file``."""
    field = location.getField
    return F.when(
        field("source") == "file",
        F.concat_ws(":", F.lit("file"), field("path"), field("line_no").cast("string")),
    ).otherwise(F.concat_ws(":", F.lit("commit"), field("hash"), field("file")))


def min_severity(findings: DataFrame, level: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") >= rank_of(parse_severity(level)))


def dedup_findings(findings: DataFrame, *keep: str) -> DataFrame:
    """One finding per (rule, matched text, location)."""
    keyed = findings.withColumn("_loc", loc_key(F.col("location")))
    return keyed.dropDuplicates([*keep, "rule_name", "matched_text", "_loc"]).drop("_loc")


def partition_covered(findings: DataFrame) -> DataFrame:
    """Add ``status``: ``covered`` by an ignore file, else ``active``."""
    status = F.when(F.col("git_ignored"), F.lit("covered")).otherwise(F.lit("active"))
    return findings.withColumn("status", status)


def findings_counts(findings: DataFrame) -> DataFrame:
    return partition_covered(findings).groupBy("status").agg(F.count("*").alias("findings"))


def gate(findings: DataFrame, level: str = "warning") -> DataFrame:
    """One row: counts of active and covered findings at or above ``level``, and whether the run passes."""
    counted = min_severity(findings, level).agg(
        F.count_if(~F.col("git_ignored")).alias("active_count"),
        F.count_if(F.col("git_ignored")).alias("covered_count"),
    )
    return counted.withColumn("passed", F.col("active_count") == 0)


def gate_passes(findings: DataFrame, level: str = "warning") -> bool:
    """The verdict alone: stops at the first active finding."""
    return min_severity(findings, level).filter(~F.col("git_ignored")).isEmpty()


def findings_rollup(findings: DataFrame, *dimensions: str) -> DataFrame:
    """Counts per rule and severity over further dimensions, with sub-totals."""
    dims = ["severity", "rule_name", *dimensions]
    return findings.rollup(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("findings"))


def finding_json(row: tuple[str, ...] = ("rule_name", "severity", "location", "matched_text", "line_content",
                                         "git_ignored")) -> Column:
    """One finding as a JSON object; unused location fields are left out."""
    return F.to_json(F.struct(*row))


def findings_report() -> Column:
    """A finding as a block of plain text."""
    loc = F.col("location").getField
    covered = F.col("git_ignored")
    head = F.when(covered, F.lit("[COVERED]")).otherwise(F.concat(F.lit("["), F.col("severity"), F.lit("]")))
    commit = F.concat_ws(" ", F.lit("commit"), loc("short_hash"), loc("file"))
    where = F.when(loc("source") == "file", F.concat_ws(":", loc("path"), loc("line_no").cast("string"))).otherwise(
        F.when(covered, commit).otherwise(F.concat_ws("  ", commit, loc("commit_message")))
    )
    return F.concat(
        head, F.lit(" "), F.col("rule_name"), F.lit("  "), where,
        F.lit("\n      match:   "), F.col("matched_text"),
        F.lit("\n      line:    "), F.col("line_content"), F.lit("\n"),
    )
