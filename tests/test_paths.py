"""Path predicates and ignore files."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from siftworks.functions import paths as P
from siftworks.operators.coverage import apply_gitignore, covered_paths, gitignore_rule_rows, load_gitignore_rules
from siftworks.operators.findings import as_findings, commit_location, file_location
from siftworks.operators.match import match_rules
from siftworks.functions.rules import default_rules
from siftworks.sources.readers import ignore_rules_by_root, paths_anti_ignores

PATH = F.col("path")


def evaluate(frame, paths, column):
    rows = frame([(i, p) for i, p in enumerate(paths)], "i int, path string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_names_and_extensions(frame):
    paths = ["a/b.PNG", ".lock", "x.lock", "a.b/c", "a.", "x.tar.gz", "d/.env"]
    assert evaluate(frame, paths, P.is_binary_ext(PATH)) == [True, False, True, False, False, True, False]
    paths = [".env", "a/.env.local", "env", "prod.env", "my.environment", "environment", "a.env/b.py"]
    assert evaluate(frame, paths, P.is_env_file(PATH)) == [True, True, True, True, True, False, False]
    paths = ["/a/b/c/deep.bin", "/", "a/", "..", "x/.", ""]
    assert evaluate(frame, paths, P.dest_path(PATH, "/out")) == [
        "/out/deep.bin", "/out/unknown", "/out/a", "/out/unknown", "/out/x", "/out/unknown"
    ]


def test_ignored(frame):
    paths = ["node_modules/a.js", "src/dist/b", "distx/b", "vendor/lib/x", "a/vendor/lib/x", "vendor/library"]
    assert evaluate(frame, paths, P.path_ignored(PATH)) == [True, True, False, False, False, False]
    assert evaluate(frame, paths, P.path_ignored(PATH, ["vendor/lib"])) == [False, False, False, True, False, False]
    assert evaluate(frame, [".git/HEAD", "a/.git/x", ".github/x"], P.skip_git_dir(PATH)) == [False, False, True]


def brute_scan_ignored(path, pattern, mode):
    path, pattern = path.replace("\\", "/"), pattern.strip()

    def matches(p):
        if pattern.endswith("/"):
            return p.startswith(pattern.rstrip("/") + "/")
        return p == pattern or p.endswith("/" + pattern)

    if mode == "history":
        return matches(path)
    parts = path.split("/")
    return any(matches("/".join(parts[:k])) for k in range(1, len(parts) + 1))


@pytest.mark.parametrize("mode", ["tree", "history"])
def test_scan_ignored(frame, mode):
    paths = ["vendor/a", "x/vendor/a", "vendor", "x/vendor", "a.txt", "b/a.txt", "b\\a.txt", "ba.txt", "vendorx/a", "b/c/d"]
    for pattern in ["vendor", "vendor/", "a.txt", "b/c", "b/c/", "/vendor", "x//", " vendor "]:
        expected = [brute_scan_ignored(p, pattern, mode) for p in paths]
        assert evaluate(frame, paths, P.path_scan_ignored(PATH, [pattern], mode)) == expected, pattern


def test_scan_ignored_from_a_table(frame):
    files = frame([("r1", "vendor/a"), ("r1", "src/a"), ("r2", "vendor/a")], "root string, path string")
    ignore = frame([("r1", ".ignore", "# c\n vendor \n\n")], "root string, path string, text string")
    rules = ignore_rules_by_root(ignore, ".ignore")
    kept = paths_anti_ignores(files, rules).collect()
    assert sorted((r.root, r.path) for r in kept) == [("r1", "src/a"), ("r2", "vendor/a")]


@pytest.mark.parametrize("mode", ["tree", "history"])
def test_ignored_paths_against_every_pattern(frame, mode):
    """Random paths and patterns, odd slashes among them, path by path; nulls and roots without patterns stay."""
    rng = random.Random(mode)
    part = lambda: rng.choice(("a", "b", "cc", "", "a.b", "d"))
    paths = [rng.choice(("/", "\\")).join(part() for _ in range(rng.randint(1, 5))) for _ in range(300)]
    patterns = ["/".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(("", "", "/", "//")) for _ in range(25)]
    patterns = sorted({p for p in patterns if p} | {"/", "/a", "a//"})
    files = frame([("r", p, i) for i, p in enumerate(paths)] + [("s", "a", 1), (None, "a", 2), ("r", None, 3)], "root string, path string, pattern int")
    rules = frame([("r", patterns), ("t", ["a"])], "root string, patterns array<string>")
    kept = sorted(map(tuple, paths_anti_ignores(files, rules, mode).collect()), key=str)
    wanted = [("r", p, i) for i, p in enumerate(paths) if not any(brute_scan_ignored(p, x, mode) for x in patterns)]
    assert kept == sorted([*wanted, ("s", "a", 1), (None, "a", 2), ("r", None, 3)], key=str) and 20 < len(wanted) < 280
    assert paths_anti_ignores(files, frame([("r", [])], "root string, patterns array<string>"), mode).count() == 303


def test_very_many_patterns_on_one_root(spark, frame):
    patterns = spark.range(100_000).select(F.concat(F.lit("dir"), F.col("id").cast("string"), F.lit("/file")).alias("p"))
    rules = patterns.agg(F.collect_list("p").alias("patterns")).select(F.lit("r").alias("root"), "patterns")
    files = spark.range(200_000).select(F.lit("r").alias("root"), F.concat(F.lit("x/dir"), F.col("id").cast("string"), F.lit("/file/deep")).alias("path"))
    start = time.monotonic()
    assert paths_anti_ignores(files, rules).count() == 100_000
    assert time.monotonic() - start < 120


def test_watched_depth(frame):
    paths = ["w", "w/a", "w/a/b", "wx"]
    assert evaluate(frame, paths, P.path_depth_ok(PATH, "w/", True)) == [True, True, True, False]
    assert evaluate(frame, paths, P.path_depth_ok(PATH, "w", False)) == [True, True, False, False]


def covered(frame, ignore_files, paths):
    files = frame([("r", p, t) for p, t in ignore_files], "repo string, path string, text string")
    rows = covered_paths(frame([("r", p) for p in paths], "repo string, path string"), load_gitignore_rules(files)).collect()
    found = {r.path for r in rows}
    return [p in found for p in paths]


CASES = [
    ([(".gitignore", ".env\n")], {".env": True, "a/.env": True, ".env.local": False}),
    ([(".gitignore", ".env*\n")], {".env": True, ".env.production": True, "x.env": False}),
    ([("packages/api/.gitignore", ".env\n")], {"packages/api/.env": True, "packages/web/.env": False, ".env": False}),
    ([(".gitignore", "**/.env\n")], {".env": True, "a/b/.env": True}),
    ([(".gitignore", ".env\n"), ("packages/public/.gitignore", "!.env\n")], {"packages/public/.env": True}),
    ([(".gitignore", "# c\n\n*.key\n!public.key\n")], {"a.key": True, "public.key": False, "d/public.key": False, "# c": False}),
    ([(".gitignore", "!public.key\n*.key\n")], {"public.key": True}),
    ([(".gitignore", "/build\nlogs/\n")], {"build": True, "build/x": True, "a/build": False, "logs": False, "logs/x": True, "a/logs/x": True}),
    ([(".gitignore", "a/*.txt\n")], {"a/x.txt": True, "a/b/x.txt": False, "c/a/x.txt": False}),
    ([(".gitignore", "a/**/z\n")], {"a/z": True, "a/b/z": True, "a/b/c/z": True, "az": False}),
    ([(".gitignore", "deep/**\n")], {"deep/x": True, "deep/x/y": True, "deep": False}),
    ([(".gitignore", "f[0-9a].t?t\n")], {"f1.txt": True, "fa.tst": True, "fb.txt": False, "f1.tt": False}),
    ([(".gitignore", "g[!0-9]\n")], {"gx": True, "g1": False}),
    ([(".gitignore", "\\#x\n\\!y\nsp\\ \ntr  \n")], {"#x": True, "!y": True, "sp ": True, "tr": True}),
    ([(".gitignore", "lit\\*\na+b.(c)\n")], {"lit*": True, "litx": False, "a+b.(c)": True, "aab.(c)": False}),
    ([(".gitignore", "crlf\r\n")], {"crlf": True}),
    ([("a/.gitignore", "/x\n")], {"a/x": True, "x": False, "a/b/x": False}),
    ([(".gitignore", "vendor/*\n!vendor/keep\n")], {"vendor/a": True, "vendor/keep": False}),
    ([(".gitignore", "vendor/\n!vendor/keep\n")], {"vendor/keep": True}),
]


@pytest.mark.parametrize("ignore_files,expected", CASES)
def test_coverage(frame, ignore_files, expected):
    assert covered(frame, ignore_files, list(expected)) == list(expected.values())


def test_rule_rows(frame):
    files = frame([("r", "a/.gitignore", "x\n\n!/y/\n"), ("r", "b.gitignore", "z")], "repo string, path string, text string")
    rows = gitignore_rule_rows(load_gitignore_rules(files)).orderBy("rule_no").collect()
    assert [(r.level_dir, r.rule_no, r.negated, r.dir_only, r.anchored, r.glob) for r in rows] == [
        ("a", 0, False, False, False, "x"), ("a", 1, True, True, True, "y")
    ]


def test_commit_findings_are_never_covered(frame):
    lines = frame([("r", ".env", "listen 10.1.2.3")], "repo string, path string, line string")
    found = match_rules(lines, default_rules())
    in_file = as_findings(found, file_location(F.col("path"), F.lit(1)), "repo")
    in_commit = as_findings(found, commit_location(F.lit("abc"), F.col("path"), F.lit(None)), "repo")
    rules = load_gitignore_rules(frame([("r", ".gitignore", ".env\n")], "repo string, path string, text string"))
    flagged = apply_gitignore(in_file.unionByName(in_commit), rules).collect()
    assert {(r.location.source, r.git_ignored) for r in flagged} == {("file", True), ("commit", False)}
    none = load_gitignore_rules(frame([("other", ".gitignore", ".env\n")], "repo string, path string, text string"))
    assert {r.git_ignored for r in apply_gitignore(in_file, none).collect()} == {False}
