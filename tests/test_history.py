"""History, deltas, ranking and the findings relation."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftworks.functions.rules import default_rules
from siftworks.operators import delta, findings, history
from siftworks.operators.ranking import ranked
from siftworks.plans import scans
from siftworks.sources.writers import findings_json_sink, findings_text_sink

TOKEN = "gh" + "p_aaaa"


def commit_log(frame, lines, commits=None):
    commits = commits or [("r", "c1" * 20, 2, 1, "old"), ("r", "c2" * 20, 1, 1, None), ("r", "c3" * 20, 0, 2, "merge")]
    log = frame(commits, "repo string, hash string, commit_pos long, parent_count int, summary string")
    schema = "repo string, hash string, file string, origin string, new_lineno int, seq long, content string"
    return log, frame([("r", h * 20, f, o, 1, s, c) for h, f, o, s, c in lines], schema)


def test_history(frame):
    first, second = TOKEN + "1" * 20, TOKEN + "2" * 20
    log, lines = commit_log(
        frame,
        [
            ("c1", "a.py", "+", 0, first + "\n"), ("c1", "a.py", "+", 1, second + "\n"), ("c1", "a.py", "-", 2, first + "\n"),
            ("c2", "a.py", "+", 0, first + "\n"), ("c2", "b.lock", "+", 1, first + "\n"),
            ("c3", "a.py", "+", 0, "gh" + "o_bbbb" + "1" * 20 + "\n"), ("c2", "node_modules/x", "+", 2, first),
            ("c2", "skip/me.py", "+", 3, first),
        ],
    )
    shown = lambda df: sorted((r.location.file, r.location.short_hash, r.location.commit_message, r.matched_text) for r in df.collect())
    redacted = history.scan_history(log, lines, default_rules(), scan_ignore=["me.py"])
    assert shown(redacted) == [("a.py", "c2c2c2c2", "", "ghp_…[redacted]"), ("b.lock", "c2c2c2c2", "", "ghp_…[redacted]")]
    raw = history.scan_history(log, lines, default_rules(), scan_ignore=["me.py"], redact=False)
    assert shown(raw) == [("a.py", "c1c1c1c1", "old", second), ("a.py", "c2c2c2c2", "", first), ("b.lock", "c2c2c2c2", "", first)]
    everything = history.scan_history(log, lines, default_rules(), dedup=False)
    assert everything.count() == 5


def test_crlf_is_kept_in_history(frame):
    """Only the line feed is cut, so a rule anchored at the end misses a path before a carriage return."""
    log, lines = commit_log(frame, [("c1", "a", "+", 0, "cd /home/alice\r\n"), ("c2", "a", "+", 0, "cd /home/alice\n")])
    found = history.scan_history(log, lines, default_rules()).collect()
    assert [r.location.short_hash for r in found] == ["c2c2c2c2"]


def test_walk_order(frame):
    log, _ = commit_log(frame, [("c1", "a", "+", 0, "x")])
    assert [r.commit_pos for r in history.walk_order(history.skip_merges(log)).collect()] == [1, 2]


def test_history_lines(frame):
    log, lines = commit_log(frame, [("c1", "a", "+", 0, "x\n"), ("c3", "a", "+", 0, "y\n"), ("c1", "a", " ", 1, "z")])
    assert [(r.content, r.summary) for r in history.history_lines(log, lines).collect()] == [("x", "old")]


def test_ranked_matches_a_window(frame):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), i) for i in rng.sample(range(500), 300)]
    attach = frame([("a", 7)], "k string, extra int")
    got = ranked(frame(rows, "k string, v int"), ["k"], F.floor(F.col("v") / 10), ["v"], attach=attach).collect()
    order = defaultdict(list)
    for k, v in sorted(rows, key=lambda r: r[1]):
        order[k].append(v)
    assert sorted((r.k, r.v, r.rank, r.extra) for r in got) == sorted(
        (k, v, i + 1, 7 if k == "a" else None) for k, vs in order.items() for i, v in enumerate(vs)
    )


def versions(seed):
    rng = random.Random(seed)
    files = []
    for n in range(40):
        old = [rng.choice("abcde") for _ in range(rng.randrange(0, 25))]
        now = [line for line in old if rng.random() < 0.7]
        for _ in range(rng.randrange(0, 4)):
            now.insert(rng.randrange(len(now) + 1), rng.choice("abcxyz"))
        files.append((f"f{n}", None if n % 9 == 0 else "\n".join(old), "\n".join(now)))
    return files


def test_delta_multiset(frame):
    files = versions(1)
    base = frame([(p, o) for p, o, _ in files if o is not None], "path string, text string")
    new = frame([(p, n) for p, _, n in files], "path string, text string")
    expected = []
    for path, old, now in files:
        had, seen = Counter((old or "").splitlines()), Counter()
        for number, line in enumerate(now.split("\n") if now else [], 1):
            seen[line] += 1
            if seen[line] > had[line] and not (number == now.count("\n") + 1 and line == ""):
                expected.append((path, number, line))
    assert sorted(map(tuple, delta.delta_lines(base, new).collect())) == sorted(expected)


def test_delta_of_long_files_and_a_line_repeated_very_often(frame):
    old = ["same"] * 200_000 + [f"l{i}" for i in range(20_000)]
    now = [f"l{i}" for i in range(19_990, -1, -1)] + ["same"] * 200_003 + ["end"]
    schema = "path string, text string"
    base, new = frame([("p", "\n".join(old)), ("q", "a")], schema), frame([("p", "\n".join(now)), ("q", "a"), ("r", None)], schema)
    found = [tuple(r) for r in delta.delta_lines(base, new).collect()]
    last = 19_991 + 200_000
    assert sorted(found) == [("p", last + i, "same") for i in (1, 2, 3)] + [("p", last + 4, "end")]


def test_delta_shuffles_hashes_and_reads_each_version_at_most_twice(spark, frame):
    schema = "path string, text string"
    base, new = frame([("p", "a")], schema), frame([("p", "b")], schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = delta.delta_lines(base, new)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3


def test_scan_delta(frame):
    schema = "path string, text string"
    base = frame([("old.py", "listen 10.1.1.1\n")], schema)
    new = frame([("old.py", "listen 10.1.1.1\nlisten 10.2.2.2\r\n"), ("new.lock", "listen 10.3.3.3")], schema)
    found = scans.scan_delta(base, new, scans.ScanOptions(redact=False)).collect()
    assert sorted((r.location.path, r.location.line_no, r.matched_text) for r in found) == [
        ("new.lock", 1, "10.3.3.3"), ("old.py", 2, "10.2.2.2")
    ]


@pytest.fixture
def found(frame):
    files = frame(
        [("r", "a.py", "listen 10.1.1.1\npassword = 'abcdefgh'"), ("r", "b.exe", "listen 10.1.1.1"), ("r", "vendor/x.py", "listen 10.1.1.1")],
        "repo string, path string, text string",
    )
    return scans.scan_tree(files, scans.ScanOptions(ignore=("vendor",)), "repo")


def test_counts_and_gate(found):
    assert found.count() == 2
    assert tuple(findings.gate(found).first()) == (2, 0, False)
    assert tuple(findings.gate(found, "critical").first()) == (0, 0, True)
    covered = found.withColumn("git_ignored", F.lit(True))
    assert tuple(findings.gate(covered).first()) == (0, 2, True)
    assert findings.gate_passes(covered) and not findings.gate_passes(found) and findings.gate_passes(found, "crit")
    assert {r.status: r.findings for r in findings.findings_counts(found.unionByName(covered)).collect()} == {"active": 2, "covered": 2}
    assert findings.dedup_findings(found.unionByName(found), "repo").count() == 2
    assert findings.min_severity(found, "high").count() == 1


def test_outputs(spark, found, tmp_path):
    row = found.select(findings.finding_json().alias("j")).collect()
    parsed = sorted((json.loads(r.j) for r in row), key=lambda d: d["rule_name"])
    assert parsed[1] == {
        "rule_name": "infra-ipv4-address", "severity": "WARNING", "location": {"source": "file", "path": "a.py", "line_no": 1},
        "matched_text": "[redacted]", "line_content": "listen [redacted]", "git_ignored": False,
    }
    findings_json_sink(found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("status = 'active'").count() == 2
    findings_text_sink(found, str(tmp_path / "text"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "text")).collect())
    assert "[WARNING] infra-ipv4-address  a.py:1" in text and "      line:    listen [redacted]" in text


def test_findings_report_of_a_commit(frame):
    log, lines = commit_log(frame, [("c1", "a.py", "+", 0, "listen 10.1.1.1\n")])
    block = history.scan_history(log, lines, default_rules()).select(findings.findings_report().alias("b")).first().b
    assert block.split("\n")[0] == "[WARNING] infra-ipv4-address  commit c1c1c1c1 a.py  old"
