"""Files, blobs, commits and events derived from the driver tables.

The expressions below are plain SQL that Spark and the checking database both
accept, so the two sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions.times import micros
from siftworks.operators.match import explode_lines
from siftworks.session import SPREAD, spread

# One line per rule that makes it fire, in catalogue order. Written as
# concatenations so that no token-shaped text is stored.
PLANTED = (
    "'-----BEGIN RSA PRIV' || 'ATE KEY-----'",
    "'-----BEGIN OPENSSH PRIV' || 'ATE KEY-----'",
    "'k = \"AK' || 'IA' || repeat('A', 16) || '\"'",
    "'aws_secret_access_key=' || repeat('a', 40)",
    "'T gh' || 'p_' || repeat('a', 24)",
    "'id Ov2' || '3li' || repeat('a', 14)",
    "'k AI' || 'za' || repeat('a', 35)",
    "'12-' || repeat('a', 32) || '.apps.googleusercontent.com'",
    "'sk_' || 'live_' || repeat('a', 24)",
    "'pk_' || 'live_' || repeat('a', 24)",
    "'sk_' || 'test_' || repeat('a', 24)",
    "'xo' || 'xb-' || repeat('1', 12)",
    "'https://hooks.slack' || '.com/services/T1/B1/abc'",
    "'S' || 'G.' || repeat('a', 22) || '.' || repeat('b', 43)",
    "'S' || 'K' || repeat('0', 32)",
    "'np' || 'm_' || repeat('a', 36)",
    "'ey' || 'J' || repeat('a', 10) || '.' || repeat('b', 10) || '.' || repeat('c', 10)",
    "'postgres' || '://u:p@h/db'",
    "'api_key = \"' || repeat('a', 20) || '\"'",
    "'app_secret = \"' || repeat('a', 10) || '\"'",
    "'password = \"' || 'abcdef1' || '\"'",
    "'token = \"' || repeat('a', 20) || '\"'",
    "'Authorization: Bearer ' || repeat('a', 10)",
    "'private_key=' || repeat('a', 30)",
    "'HEROKU_KEY=' || repeat('0', 8) || '-0000-0000-0000-' || repeat('0', 12)",
    "'https://u:pass' || '@a.example.com/x'",
    "'mailgun_api_key=key-' || repeat('a', 32)",
    "'s' || 'k-' || repeat('a', 32)",
    "'s' || 'k-ant-' || repeat('a', 32)",
    "'azure_key=' || repeat('0', 32)",
    "'cloudflare_token=' || repeat('a', 37)",
    "'eyJ' || 'hbGciA.b.c'",
    "'vercel_token=' || repeat('a', 24)",
    "'lin_' || 'api_' || repeat('a', 36)",
    "'secret' || '_' || repeat('a', 36)",
    "'pagerduty_key=' || repeat('a', 20)",
    "'dd_api_key=' || repeat('0', 32)",
    "'dop_' || 'v1_' || repeat('a', 64)",
    "'https://' || repeat('0', 32) || '@o1.ingest.sentry.io/1'",
    "'okta_token=' || repeat('a', 40)",
    "'addr 10.1.2.3:80'",
    "'h db-primary.internal'",
    "'http://svc.a.internal/x'",
    "'p /home/alice'",
    "'MY_VAR=hello'",
    "'DB_PASSWORD=abc'",
)
# Lines on which a rule's pattern matches and its allowlist does too.
EXCUSED = (
    "'password: string'",
    "'listen 127.0.0.1 and 10.0.0.5'",
    "'http://localhost.a.internal/x localhost'",
    "'<path d=\"M1.2.3.4\">'",
)


def _case(selector: str, choices: tuple[str, ...]) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def planted_text(key: str) -> str:
    """SQL for a text with a line for one of the rules, chosen by the row's key."""
    return f"text || chr(10) || {_case(f'{key} % {len(PLANTED)}', PLANTED)}"


PLANT = _case(f"doc_id % {len(PLANTED)}", PLANTED)
EXCUSE = _case(f"doc_id % {len(EXCUSED)}", EXCUSED)
PLANTED_TEXT = f"text || chr(10) || {PLANT}"
EXCUSED_TEXT = f"text || chr(10) || {EXCUSE}"

_GROUP = f"CAST(floor(doc_id / {len(PLANTED)}) AS BIGINT) % 8"
_EXT = _case(_GROUP, ("'.py'", "'.env'", "'.lock'", "'.png'", "'.md'", "'.env.local'", "'.js'", "'/env'"))
_FOLDER = _case(
    "doc_id % 10",
    ("'.git/'", "'node_modules/'", "'vendor/'", "'src/'", "'docs/vendor/'", "''", "'keep/'", "'build/out/'", "'src/app/'", "''"),
)
REPO = "source"
PATH = f"{_FOLDER} || 'd' || doc_id || {_EXT}"

# Blobs: leading bytes of a file type, the text, and for some the JPEG end marker, all as hex.
_MAGIC = _case(
    "doc_id % 10",
    ("'FFD8FFE0'", "'89504E47'", "'47494638'", "'424D'", "'4D5A'", "'CAFEBABE'", "'CAFED00D'", "'25504446'", "''", "''"),
)
_MARK = "CASE WHEN doc_id % 20 = 0 THEN 'FFD9' ELSE '' END"
BLOB_HEX = f"{_MAGIC} || hex(encode(text)) || {_MARK}"

COMMIT_HASH = "md5('commit ' || doc_id)"
COMMIT_FILE = "CASE WHEN lang = 'es' THEN 'conf/.env' WHEN lang = 'de' THEN 'vendor/a.lock' ELSE 'src/' || lang || '.py' END"
PARENTS = "CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END"
SUMMARY = "CASE WHEN lang = 'fr' THEN NULL ELSE 'import ' || doc_id END"

# A commit graph: four repositories, branches that leave commits behind, merges, parents out of the table, skewed clocks.
GRAPH_REPO = "'r' || (doc_id % 4)"
_FIRST_PARENT = "md5('commit ' || (doc_id - CASE WHEN doc_id % 11 = 3 THEN 8 ELSE 4 END))"
_SECOND_PARENT = "md5('commit ' || (doc_id - 20))"
GRAPH_TIME = "CAST(floor(doc_id / 3) AS BIGINT) + CASE WHEN doc_id % 17 = 2 THEN 10 ELSE 0 END"
GRAPH_HEAD = "doc_id % 29 = 5"

EVENT_KIND = (
    "CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'modify' "
    "WHEN 'error' THEN 'remove' ELSE 'access' END"
)
EVENT_DETAIL = (
    "CASE event_type WHEN 'click' THEN 'data' WHEN 'purchase' THEN "
    "CASE event_id % 7 WHEN 0 THEN 'name_from' WHEN 1 THEN 'name_to' WHEN 2 THEN 'name_both' WHEN 3 THEN 'name_other' "
    "ELSE 'name_any' END END"
)
EVENT_PATH = "'u' || (user_id % 20) || CASE WHEN user_id % 3 = 0 THEN '/sub' ELSE '' END || '/f' || (event_id % 5)"

# Offsets of single-byte edits: from the start, and for some blobs across the border of a stretch.
EDIT_OFFSET = "event_id % 512 + CASE WHEN user_id % 7 = 0 THEN 65280 ELSE 0 END"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, cut to the columns in use; spread over the cores if the session asks for that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    picked = df.select(*columns) if columns else df
    return spread(picked) if spark.conf.get(SPREAD, "false") == "true" else picked


def planted(spark: SparkSession, sf_dir: str, text: str = PLANTED_TEXT) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.expr(text).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, repo, path, text)``: one file per document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return docs.select(
        "doc_id", F.expr(REPO).alias("repo"), F.expr(PATH).alias("path"), F.expr(PLANTED_TEXT).alias("text")
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: documents with the leading bytes of various file types."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    content = F.concat(F.expr(f"unhex({_MAGIC})"), F.encode("text", "UTF-8"), F.expr(f"unhex({_MARK})"))
    return docs.select("doc_id", F.expr("'d' || doc_id").alias("path"), content.alias("content"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return docs.select(
        F.expr(REPO).alias("repo"),
        F.expr(COMMIT_HASH).alias("hash"),
        (-F.col("doc_id")).alias("commit_pos"),
        F.expr(PARENTS).alias("parent_count"),
        F.expr(SUMMARY).alias("summary"),
    )


def commit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(repo, hash, parents, time, parent_count, summary)`` and the heads: some branches, and the last commit of every repository."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang").withColumn("repo", F.expr(GRAPH_REPO))
    parents = F.expr(f"CASE WHEN doc_id % 7 = 0 THEN array({_FIRST_PARENT}, {_SECOND_PARENT}) ELSE array({_FIRST_PARENT}) END")
    commits = docs.select(
        "repo", F.expr(COMMIT_HASH).alias("hash"), parents.alias("parents"), F.expr(GRAPH_TIME).alias("time"),
        F.size(parents).alias("parent_count"), F.expr(SUMMARY).alias("summary"),
    )
    last = docs.groupBy("repo").agg(F.max("doc_id").alias("doc_id"))
    heads = docs.where(GRAPH_HEAD).select("repo", "doc_id").unionByName(last)
    return commits, heads.select("repo", F.expr(COMMIT_HASH).alias("hash"))


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    lines = explode_lines(
        docs.select(
            F.expr(REPO).alias("repo"),
            F.expr(COMMIT_HASH).alias("hash"),
            F.expr(COMMIT_FILE).alias("file"),
            F.expr(PLANTED_TEXT).alias("text"),
        )
    )
    return lines.select(
        "repo",
        "hash",
        "file",
        F.when(F.startswith("line", F.lit("D")), F.lit("-")).otherwise(F.lit("+")).alias("origin"),
        F.col("line_no").alias("new_lineno"),
        F.col("line_no").cast("long").alias("seq"),
        F.concat("line", F.lit("\n")).alias("content"),
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, ts, ts_micros, path, kind, kind_detail)``."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return as_file_events(events)


def as_file_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        micros(F.col("ts")).alias("ts_micros"),
        F.expr(EVENT_PATH).alias("path"),
        F.expr(EVENT_KIND).alias("kind"),
        F.expr(EVENT_DETAIL).alias("kind_detail"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-byte edits typed into the blobs of the first documents, one per event."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return events.select(
        F.expr("'d' || user_id").alias("path"),
        F.col("event_id").alias("seq"),
        F.expr(EDIT_OFFSET).alias("offset"),
        F.expr("CAST(floor(value) AS BIGINT) % 256").cast("smallint").alias("byte"),
    )
