"""Which paths are covered by version-control ignore files.

Each ignore file is one row holding its rules as an array, so the rules of a file
are never collected from elsewhere.  A path meets an ignore file through an equal
(repo, directory) key for each of its own directories; Spark broadcasts the ignore
files when they are small and splits skewed keys when they are not.

Every ignore file is judged by itself: its last matching rule decides for a path
and for each of its parent directories, and a path is covered when any of its
ignore files covers it.  A negation therefore never overrides another file's rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions.text import split_lines

# Where ignore rules are kept.
IGNORE_FILE = ".gitignore"
EXCLUDE_FILE = ".git/info/exclude"

# A pattern is cut into these tokens, tried in this order.
_TOKENS = (
    r"(\\.|\[[!^]?\]?(?:\\.|[^\]\\])*\]|^\*\*/|/\*\*/|/\*\*$|\*+|\?|[^\\\[*?/]+|.)"
)


def _token_regex(token: Column) -> Column:
    """Java regex for one token of a glob; ``*`` and ``?`` never cross a ``/``."""
    inner = F.regexp_replace(F.regexp_replace(token, r"^\[[!^]?|\]$", ""), r"([\[&])", r"\\$1")
    return (
        F.when(token == "**/", F.lit(r"(?:.*/)?"))
        .when(token == "/**/", F.lit(r"/(?:.*/)?"))
        .when(token == "/**", F.lit(r"/.+"))
        .when(F.startswith(token, F.lit("*")), F.lit(r"[^/]*"))
        .when(token == "?", F.lit(r"[^/]"))
        .when(token.rlike(r"^\[[!^].+\]$"), F.concat(F.lit("[^/"), inner, F.lit("]")))
        .when(token.rlike(r"^\[.+\]$"), F.concat(F.lit("["), inner, F.lit("]")))
        .when(token.rlike(r"^\\."), F.concat(F.lit(r"\Q"), F.substring(token, 2, 1), F.lit(r"\E")))
        .otherwise(F.concat(F.lit(r"\Q"), token, F.lit(r"\E")))
    )


def parse_rule(line: Column) -> Column:
    """Struct for one line of an ignore file, NULL for blanks and comments."""
    text = F.regexp_replace(line, r"(?<!\\)[ \t\r]+$", "")
    negated = F.startswith(text, F.lit("!"))
    body = F.when(negated, F.substr(text, F.lit(2))).otherwise(text)
    dir_only = F.endswith(body, F.lit("/"))
    body = F.regexp_replace(body, "/+$", "")
    anchored = F.contains(body, F.lit("/"))
    glob = F.regexp_replace(body, "^/", "")
    literal = ~glob.rlike(r"[\\\[*?]")
    # most globs are one star around plain text, which needs no regex
    form = (
        F.when(literal, F.lit("exact"))
        .when(~anchored & glob.rlike(r"^\*[^\\\[*?]+$"), F.lit("ends"))
        .when(~anchored & glob.rlike(r"^[^\\\[*?]+\*$"), F.lit("starts"))
        .when(glob.rlike(r"^[^\\\[*?]+/\*\*$"), F.lit("below"))
        .otherwise(F.lit("regex"))
    )
    tokens = F.regexp_extract_all(glob, F.lit(_TOKENS), F.lit(1))
    regex = F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, _token_regex), ""), F.lit(r"\z"))
    usable = (glob != "") & ~F.startswith(text, F.lit("#"))
    return F.when(
        usable,
        F.struct(
            negated.alias("negated"),
            dir_only.alias("dir_only"),
            anchored.alias("anchored"),
            literal.alias("literal"),
            F.when(literal, glob).otherwise(regex).alias("glob"),
            form.alias("form"),
            F.when(form == "ends", F.substr(glob, F.lit(2)))
            .when(form == "starts", F.regexp_replace(glob, r"\*$", ""))
            .when(form == "below", F.regexp_replace(glob, r"\*\*$", ""))
            .alias("part"),
        ),
    )


def is_ignore_file(path: Column) -> Column:
    return (path == IGNORE_FILE) | F.endswith(path, F.lit("/" + IGNORE_FILE)) | (path == EXCLUDE_FILE)


def load_gitignore_rules(files: DataFrame) -> DataFrame:
    """Ignore files among ``files(repo, path, text)`` as ``(repo, level_dir, rules)``; the exclude file counts at the root."""
    path = F.col("path")
    level = F.when(path == EXCLUDE_FILE, F.lit("")).otherwise(F.regexp_replace(path, r"/?[^/]*\z", ""))
    rules = F.array_compact(F.transform(F.coalesce(split_lines(F.col("text")), F.array()), parse_rule))
    return files.filter(is_ignore_file(path)).select("repo", level.alias("level_dir"), rules.alias("rules"))


def gitignore_rule_rows(rules: DataFrame) -> DataFrame:
    """The rules as rows, for reports."""
    return rules.select("repo", "level_dir", F.posexplode("rules").alias("rule_no", "rule")).select(
        "repo", "level_dir", "rule_no", *[f"rule.{x}" for x in ("negated", "dir_only", "anchored", "literal", "glob")]
    )


def _verdict(candidate: Column, is_dir: Column, rules: Column) -> Column:
    """True if the last rule matching ``candidate`` is not a negation."""
    base = F.substring_index(candidate, "/", -1)

    def matches(rule: Column) -> Column:
        subject = F.when(rule["anchored"], candidate).otherwise(base)
        part = rule["part"]
        same = (
            F.when(rule["form"] == "exact", subject == rule["glob"])
            .when(rule["form"] == "ends", F.endswith(subject, part))
            .when(rule["form"] == "starts", F.startswith(subject, part))
            .when(rule["form"] == "below", F.startswith(subject, part) & (subject != part))
            .otherwise(F.rlike(subject, rule["glob"]))
        )
        return (is_dir | ~rule["dir_only"]) & same

    return F.aggregate(
        rules,
        F.lit(False),
        lambda verdict, rule: F.when(matches(rule), ~rule["negated"]).otherwise(verdict),
    )


def covered_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``(repo, path)`` that are covered."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    # one row per directory that may hold an ignore file for the path, the root included
    levels = (
        paths.select("repo", "path")
        .distinct()
        .withColumn("_parts", parts)
        .select("repo", "path", "_parts", F.explode(F.sequence(F.lit(0), depth - 1)).alias("_level"))
        .withColumn("level_dir", F.array_join(F.slice("_parts", F.lit(1), F.col("_level")), "/"))
    )
    met = levels.join(rules, ["repo", "level_dir"])
    rest = F.slice("_parts", F.col("_level") + 1, F.size("_parts"))
    n = F.size(rest)
    candidate = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: _verdict(F.array_join(F.slice(rest, F.lit(1), k), "/"), k < n, F.col("rules")),
    )
    return met.filter(F.exists(candidate, lambda v: v)).select("repo", "path").distinct()


def apply_gitignore(findings: DataFrame, rules: DataFrame, repo: str = "repo") -> DataFrame:
    """Set ``git_ignored`` on file findings; findings in commits are never covered.

    The findings are used twice, for their paths and for the result: pass them
    ``staged`` when they come from a scan.
    """
    in_file = F.col("location.source") == "file"
    paths = findings.filter(in_file).select(F.col(repo).alias("repo"), F.col("location.path").alias("path"))
    covered = covered_paths(paths, rules).select(
        F.col("repo").alias("_repo"), F.col("path").alias("_path"), F.lit(True).alias("_covered")
    )
    # a commit finding has no path; its own key keeps all of them from meeting in one task
    key = F.coalesce(F.col("location.path"), F.concat("location.hash", F.lit(":"), "location.file", "matched_text"))
    keyed = findings.withColumn("_key", key)
    joined = keyed.join(covered, (F.col(repo) == F.col("_repo")) & (F.col("_key") == F.col("_path")) & in_file, "left")
    flagged = joined.withColumn("git_ignored", F.coalesce("_covered", F.lit(False)))
    return flagged.drop("_repo", "_path", "_key", "_covered")
