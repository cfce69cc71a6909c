"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is known by the SHA-256 of its text. The ledger
holds which (blob, rule version) pairs were scanned and what was found in them,
so a run scans a text only if no earlier run did and joins all findings back to
every path that holds the blob. Findings are code point offsets.

A literal test decides in the pass that hashes the texts whether a rule can match
at all; only such texts are shuffled, one for each blob. A run writes its findings
first and then the scanned pairs, both under one batch id; findings of a batch that
never got to the second step are not read, so a run that died is simply repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.session import staged


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is matched left to right without overlap; matches whose ``group`` is shorter than ``least`` go.

    ``gate`` is a cheap SQL condition on ``text`` that holds wherever the pattern matches.
    """

    kind: str
    pattern: str
    group: int
    least: int
    gate: str


# The fixed patterns. Runs of one class that are long enough are the long ones of all runs, so the last
# two need no filter; a short value in the first one still uses up its text.
RULES = (
    SecretRule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        r"""(contains(text, ':') OR contains(text, '=')) AND text RLIKE '(?i)(?:passw|secret|token|api_?key)'""",
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "contains(text, 'AKIA')"),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32, "text RLIKE '[0-9a-f]{32}'"),
)
RULE_VERSION = "base-1"

_SCANNED = "blob binary, rule_version string, batch string"
_FOUND = "blob binary, kind string, start long, end long, rule_version string, batch string"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _pieces(rule: SecretRule) -> Column:
    """For each match its length, the length of its group and the length of the text since the match before."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    between = F.split("text", rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.transform(
        F.sequence(F.lit(1), F.size(hits)),
        lambda i: F.struct(
            i.alias("nth"),
            F.lit(rule.kind).alias("kind"),
            F.char_length(F.element_at(between, i)).cast("long").alias("before"),
            F.char_length(F.element_at(hits, i)).cast("long").alias("length"),
            F.char_length(F.element_at(values, i)).alias("value"),
            F.lit(rule.least).alias("least"),
        ),
    )
    none = F.array().cast("array<struct<nth:int,kind:string,before:bigint,length:bigint,value:int,least:int>>")
    return F.when(F.expr(rule.gate) & (F.size(hits) > 0), rows).otherwise(none)


def find_secrets(texts: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``(blob, kind, start, end)`` of every finding in ``texts (blob, text)``, one row per blob."""
    hits = texts.select("blob", F.explode(F.concat(*[_pieces(r) for r in rules])).alias("hit")).select("blob", "hit.*")
    # a running sum in place of offsets: the text before each match and all matches before it
    so_far = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.expr("before + length")).over(so_far)
    return (
        hits.withColumn("end", ends)
        .where("value >= least")
        .select("blob", "kind", F.expr("end - length").alias("start"), "end")
    )


def update_ledger(
    versions: DataFrame, ledger: str, rules: tuple[SecretRule, ...] = RULES, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Scan what the ledger has not seen; give the findings of all blobs under this rule version.

    ``versions`` holds ``(blob, text)`` with a null text where no rule can match.
    """
    spark, batch = versions.sparkSession, uuid.uuid4().hex
    scanned = _read(spark, f"{ledger}/scanned", _SCANNED)
    new = versions.select("blob", "text")
    if scanned is not None:
        new = new.join(scanned.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    new = staged(new.groupBy("blob").agg(F.any_value("text", ignoreNulls=True).alias("text")), "unseen")
    stamp = {"rule_version": F.lit(rule_version), "batch": F.lit(batch)}
    find_secrets(new.where("text IS NOT NULL"), rules).withColumns(stamp).write.mode("append").parquet(f"{ledger}/found")
    new.select("blob").withColumns(stamp).write.mode("append").parquet(f"{ledger}/scanned")
    done = spark.read.schema(_SCANNED).parquet(f"{ledger}/scanned").where(F.col("rule_version") == rule_version)
    found = spark.read.schema(_FOUND).parquet(f"{ledger}/found").where(F.col("rule_version") == rule_version)
    return found.join(done.select("batch").distinct(), "batch", "left_semi").select("blob", "kind", "start", "end")


def scan_versions(
    docs: DataFrame,
    ledger: str,
    paths: tuple[str, ...] = ("doc_id",),
    rules: tuple[SecretRule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """For each row of ``docs`` its ``paths`` columns, ``blob`` and ``secrets``: its findings by start, then kind as listed.

    A null text is the empty text. Nulls and repeats in ``paths`` are kept as they
    are, one result for each row; other columns are ignored. No finding gives an
    empty array, an empty table an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gate = F.expr(" OR ".join(f"({r.gate})" for r in rules))
    versions = staged(
        docs.select(*paths, text.alias("text")).select(
            *paths, F.unhex(F.sha2("text", 256)).alias("blob"), F.when(gate, F.col("text")).alias("text")
        ),
        "versions",
    )
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    found = (
        update_ledger(versions, ledger, rules, rule_version)
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("secrets"))
    )
    none = F.array().cast(found.schema["secrets"].dataType)
    return versions.select(*paths, "blob").join(found, "blob", "left").withColumn("secrets", F.coalesce("secrets", none))


def spans_text(secrets: Column | str) -> Column:
    """Findings as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that findings cover replaced by ``mask``; overlapping findings are one stretch."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(so_far: Column, x: Column) -> Column:
        gap = F.substring(text, (so_far["at"] + 1).cast("int"), (x["start"] - so_far["at"]).cast("int"))
        inside = x["start"] < so_far["at"]
        return F.struct(
            F.greatest(so_far["at"], x["end"]).alias("at"),
            F.when(inside, so_far["done"]).otherwise(F.concat(so_far["done"], gap, F.lit(mask))).alias("done"),
        )

    rest = lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(secrets) == 0, text).otherwise(F.aggregate(secrets, start, step, rest))


def redact_secrets(
    docs: DataFrame, ledger: str, rules: tuple[SecretRule, ...] = RULES, rule_version: str = RULE_VERSION, mask: str = "[SECRET]"
) -> DataFrame:
    """The rows of ``docs`` with the secrets of ``text`` masked; ``n_chars``, if there, is counted again in changed texts.

    Only texts that a rule may match meet the findings; all others pass as they are. Other columns stay, whatever their names.
    """
    gate = F.coalesce(F.expr(" OR ".join(f"({r.gate})" for r in rules)), F.lit(False))
    suspect = docs.where(gate).select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2("text", 256)).alias("blob"))
    versions = staged(suspect.select("blob", F.col("row.text").alias("text")), "suspects")
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    found = (
        update_ledger(versions, ledger, rules, rule_version)
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("secrets"))
    )
    none = F.array().cast(found.schema["secrets"].dataType)
    text = redact(F.col("row.text"), F.coalesce("secrets", none), mask)
    changed = suspect.join(found, "blob", "left").withColumn("new", text)
    as_new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        as_new["n_chars"] = F.when(F.col("secrets").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(kind))
    columns = [as_new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return docs.where(~gate).unionByName(changed.select(*columns))
