"""Reading trees and ignore files, and whole scans of a folder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siftworks.plans import scans
from siftworks.session import local_session, spread, staged, work_dir
from siftworks.sources import readers
from siftworks.sources.trees import walk_tree

ADDRESS = "listen 10.1.2.3\n"


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.py": ADDRESS, "sub/b.py": ADDRESS, "app.exe": ADDRESS, "Cargo.lock": ADDRESS, ".env": "DB_PASSWORD=abc\n" + ADDRESS,
        ".git/COMMIT_EDITMSG": ADDRESS, "node_modules/m.js": ADDRESS, "vendor/secret.js": ADDRESS, "skip/c.py": ADDRESS,
        ".gitignore": ".env\n", "sub/.gitignore": "b.*\n", "space dir/d.py": ADDRESS,
    }
    for name, text in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "root" / "bad.txt").write_bytes(b"\xff\xfe listen 10.1.2.3")
    (tmp_path / "root" / "bom.txt").write_bytes(b"\xef\xbb\xbflisten 10.1.2.3")
    return tmp_path / "root"


def test_read_tree(spark, tree):
    (tree / "link").symlink_to(tree / "a.py")
    (tree / "loop").symlink_to(tree)
    kept = readers.read_tree(spark, str(tree), ignore=("vendor", "node_modules"), scan_ignore=["skip"])
    assert {r.path for r in kept.select("path").collect()} == {
        "a.py", "sub/b.py", "app.exe", "Cargo.lock", ".env", ".gitignore", "sub/.gitignore", "bad.txt", "bom.txt", "space dir/d.py"
    }
    contents = {r.path: bytes(r.content) for r in kept.collect()}
    assert contents["sub/b.py"] == ADDRESS.encode()
    texts = {r.path for r in readers.decode_text(kept).collect()}
    assert texts == set(contents) - {"app.exe", "Cargo.lock", "bad.txt"}


def test_walk_shallow(spark, tree):
    found = walk_tree(spark, str(tree), recursive=False).collect()
    assert {r.path for r in found} == {"a.py", "app.exe", "Cargo.lock", ".env", ".gitignore", "bad.txt", "bom.txt"}
    assert {r.path: r.length for r in found}["a.py"] == len(ADDRESS)
    assert walk_tree(spark, str(tree / "nothing")).count() == 0


def test_contents_in_small_batches(spark, tree, monkeypatch):
    from siftworks.sources import trees

    monkeypatch.setattr(trees, "BATCH_BYTES", 10)
    monkeypatch.setattr(trees, "PARTITION_BYTES", 20)
    listing = walk_tree(spark, str(tree))
    read = trees.with_content(listing)
    assert read.count() == listing.count() == 14
    assert read.filter(F.octet_length("content") != F.col("length")).count() == 0


def test_scan_directory(spark, tree):
    options = scans.ScanOptions(ignore=("vendor",), scan_ignore=("skip/",))
    found = scans.scan_directory(spark, str(tree), options).collect()
    by_path = {}
    for r in found:
        by_path.setdefault(r.location.path, set()).add((r.rule_name, r.git_ignored))
    address = "infra-ipv4-address"
    assert by_path["a.py"] == {(address, False)}
    assert by_path["sub/b.py"] == {(address, True)}
    assert by_path[".env"] == {(address, True), ("env-var-any", True), ("env-var-sensitive", True)}
    assert by_path["bom.txt"] == {(address, False)}
    assert not {p for p in by_path if p.startswith(("vendor", "skip", "node_modules", ".git/")) or p in ("app.exe", "Cargo.lock", "bad.txt")}


def test_large_files_are_scanned_in_chunks(spark, tree, monkeypatch):
    """The same findings whether a file is read as one value or in chunks, few or many of them."""
    options = scans.ScanOptions(ignore=("vendor",), scan_ignore=("skip/",))
    rows = lambda: sorted(map(str, scans.scan_directory(spark, str(tree), options).collect()))
    (tree / "long.py").write_text("x = 1\r\n" * 500 + ADDRESS + "\nlisten 10.0.0.9" * 300)
    wanted = rows()
    assert len(wanted) > 300
    for most in (0, 20):
        monkeypatch.setattr(scans, "WHOLE_BYTES", most)
        assert rows() == wanted
    listed = walk_tree(spark, str(tree)).filter("path IN ('long.py', 'a.py', 'bad.txt')")
    in_pieces = scans.scan_large_files(listed, options, chunk=7).collect()
    assert len(in_pieces) == sum("long.py" in r or "'a.py'" in r for r in wanted)


def test_a_directorys_own_ignore_file_and_global_ignores(spark, tmp_path):
    for name in ("a.py", "b.py", "c.py", "docs/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(ADDRESS)
    (tmp_path / ".git").mkdir()
    (tmp_path / scans.IGNORE_FILE).write_text("# mine\n b.py \n\ndocs/\n")

    def found(**options):
        rows = scans.scan_directory(spark, str(tmp_path), scans.ScanOptions(**options)).collect()
        return {(r.location.path, r.git_ignored) for r in rows}

    assert found() == {("a.py", False), ("c.py", False)}
    assert found(scan_ignore=("c.py",), global_ignores=("a.*",)) == {("a.py", True)}
    assert {p for p, _ in found(ignore_file=None)} == {"a.py", "b.py", "c.py", "docs/d.py"}


def test_coverage_needs_a_repository(spark, tmp_path):
    (tmp_path / ".env").write_text(ADDRESS)
    (tmp_path / ".gitignore").write_text(".env\n")
    (tmp_path / "x.py").write_text(ADDRESS)

    def covered():
        found = scans.scan_directory(spark, str(tmp_path), scans.ScanOptions()).collect()
        return {(r.location.path, r.git_ignored) for r in found}

    assert covered() == {(".env", False), ("x.py", False)}
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("x.*\n")
    assert covered() == {(".env", True), ("x.py", True)}


def test_ignore_file(spark, tmp_path):
    (tmp_path / "ignore").write_text("# comment\n\n  vendor/ \n\tx.txt\n#y\n")
    assert readers.load_ignore_rules(spark, str(tmp_path / "ignore")) == ["vendor/", "x.txt"]
    assert readers.load_ignore_rules(spark, str(tmp_path / "missing")) == []


def test_manifest_reads_no_content(spark, tmp_path):
    (tmp_path / "alphabet").write_text("abcdefghijklmnopqrstuvwxyz")
    (tmp_path / "zeros").write_bytes(bytes(10_000))
    files = readers.binary_files(spark, str(tmp_path))
    listing = readers.manifest(files)
    assert {r.path: r.length for r in listing.collect()} == {"alphabet": 26, "zeros": 10_000}
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    digests = {r.path: r.sha256 for r in readers.inventory(files).collect()}
    assert digests["alphabet"] == "71c480df93d6ae2f1efad1447c66c9525e316218cf51fc8d9ed832f2daf18b73"


def test_scan_repository_joins_sources(frame):
    files = frame([("r", ".env", ADDRESS), ("r", ".gitignore", ".env\n"), ("s", ".env", ADDRESS)], "repo string, path string, text string")
    commits = frame([("r", "c" * 40, 0, 1, "m")], "repo string, hash string, commit_pos long, parent_count int, summary string")
    lines = frame(
        [("r", "c" * 40, ".env", "+", 1, 0, ADDRESS)],
        "repo string, hash string, file string, origin string, new_lineno int, seq long, content string",
    )
    found = scans.scan_repository(files, scans.ScanOptions(), commits=commits, commit_lines=lines).collect()
    assert {(r.repo, r.location.source, r.git_ignored) for r in found} == {
        ("r", "file", True), ("s", "file", False), ("r", "commit", False)
    }
    assert len(scans.scan_repository(files, scans.ScanOptions()).collect()) == 2


def test_working_folder(spark):
    one, two = work_dir(spark, "t"), work_dir(spark, "t")
    assert one != two
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert not base or one.startswith(base.rstrip("/") + "/t-")
    assert staged(spark.range(3), "t").count() == 3


def test_spread(spark):
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10, 1, 64)
    assert spread(wide, "id") is wide
    assert local_session(4, 4) is not None and F.lit(1) is not None


def test_empty_folders(spark, tmp_path):
    assert walk_tree(spark, str(tmp_path)).count() == 0
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "f").write_text("x")
    assert [r.path for r in walk_tree(spark, str(tmp_path)).collect()] == ["a/f"]


def test_names_are_listed_and_files_measured(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in (("a", 0), ("sub/b", 7), ("sub/.c", 12)):
        (tmp_path / name).write_bytes(b"x" * size)
        os.utime(tmp_path / name, ns=(5_000_000_999, 1_700_000_000_123_456_789))
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    os.mkfifo(tmp_path / "pipe")
    found = walk_tree(spark, str(tmp_path)).select("path", "length", F.unix_micros("modificationTime").alias("m"))
    assert sorted(map(tuple, found.collect())) == [(p, n, 1_700_000_000_123_456) for p, n in (("a", 0), ("sub/.c", 12), ("sub/b", 7))]
    # a folder is not measured by the task that lists it
    assert "measured-" in "".join(walk_tree(spark, str(tmp_path)).inputFiles())
