from __future__ import annotations

import hashlib
import re

import pytest
from cases import DOCS, docs, got
from pyspark.sql import functions as F

from siftworks.llm import secret_ledger as S
from siftworks.session import work_dir

KEY = "AK" + "IA" + "Z" * 16
TEXTS = [
    (20, "é🎉 Pass" + "word = 'abc12345' and token: short then api_key=" + "k" * 9 + " " + KEY),
    (21, "sec" + "ret=to" + 'ken: "abcdefgh12"'),
    (22, "x" * 50 + "0123456789abcdef" * 2 + "f-" + "a" * 31 + " AK" + "IAshort"),
    (23, "token=abcdefgh\n" * 300),
    (24, "TOKEN = 0123456789abcdef0123456789abcdef"),
]
PATTERNS = (
    ("assign", r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def brute(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_spans_against_python(spark, frame):
    rows = DOCS + TEXTS
    result = S.scan_versions(docs(frame, rows), work_dir(spark, "ledger")).select("doc_id", S.spans_text("secrets").alias("s"))
    wanted = sorted(((d, brute(t)) for d, t in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got(result, "doc_id", "s") == wanted


def test_later_runs_scan_unseen_pairs_only(spark, frame):
    ledger = work_dir(spark, "ledger")
    first = frame([("a", 1, TEXTS[0][1]), ("b", 1, None)], "path string, version int, text string")
    later = frame([("a", 1, TEXTS[0][1]), ("c", 2, TEXTS[0][1]), ("a", 2, TEXTS[1][1])], "path string, version int, text string")
    paths = ("path", "version")
    S.scan_versions(first, ledger, paths).collect()
    found = S.scan_versions(later, ledger, paths).select("path", "version", S.spans_text("secrets").alias("s"))
    assert got(found, "path", "version", "s") == sorted(
        [("a", 1, brute(TEXTS[0][1])), ("c", 2, brute(TEXTS[0][1])), ("a", 2, brute(TEXTS[1][1]))], key=lambda r: tuple((False, str(x)) for x in r)
    )
    scanned = spark.read.parquet(f"{ledger}/scanned").groupBy("batch").count()
    assert sorted(r["count"] for r in scanned.collect()) == [1, 2]
    S.scan_versions(first, ledger, paths, rule_version="base-2").collect()
    assert spark.read.parquet(f"{ledger}/scanned").count() == 5


def test_findings_of_a_broken_batch_are_not_read(spark, frame):
    ledger = work_dir(spark, "ledger")
    blob = hashlib.sha256(b"nothing").digest()
    frame([(blob, "hex", 0, 5, S.RULE_VERSION, "lost")], S._FOUND).write.parquet(f"{ledger}/found")
    found = S.scan_versions(docs(frame, [(1, "nothing")]), ledger)
    assert [r["secrets"] for r in found.collect()] == [[]]


def test_redaction_keeps_rows_and_columns(spark, frame):
    table = docs(frame, DOCS + TEXTS).withColumn("n_chars", F.char_length("text"))
    result = S.redact_secrets(table, work_dir(spark, "ledger"))
    assert result.columns == table.columns
    rows = {r["doc_id"]: r for r in result.collect()}
    assert result.count() == len(DOCS + TEXTS) and "Z" * 16 not in rows[20]["text"]
    assert rows[24]["text"] == "[SECRET]" and rows[24]["n_chars"] == 8 and rows[24]["blob"] == "x"
    assert rows[23]["text"] == "[SECRET]\n" * 300 and rows[1]["text"] == DOCS[0][1]


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, frame, rows):
    assert got(S.scan_versions(docs(frame, rows), work_dir(spark, "ledger")), "doc_id") == []
