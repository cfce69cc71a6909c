"""Lines and rule matching.

Every rule is unrolled into the plan as literals, so each regex is compiled once
per task.  A cheap filter (one pass over the line as it is for all literals) keeps nearly all
lines away from the regexes; only the rest is case-folded and tried rule by rule,
behind tests shared by many rules and each rule's own anchors.  Custom rules whose form a backtracking engine
cannot take on long lines are run by a linear-time one.  The filter reads columns of the line generator,
so it runs in the same stage, after any repartitioning of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.functions.dialect import first_match_prefix, to_java
from siftworks.functions.linear import first_matches
from siftworks.functions.rules import GATES, Rule
from siftworks.functions.severity import rank_of
from siftworks.functions.text import fold, split_lines, trim_end

# The replacement text, the tail of a shortened token, and the byte
# limits of the token that is shortened and of what is kept of it.
REDACTED = "[redacted]"
SHORTENED = "…[redacted]"
SHORTEN_ABOVE_BYTES = 8
KEEP_BYTES = 4


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in text)


def any_literal(literals: Sequence[str]) -> str:
    """A pattern that finds any of these ASCII literals in one pass over a line.

    A ``contains`` for each of them would read the line once for each. Every literal is looked for at its first character
    that is rare in prose, no lower-case letter or blank, so most characters take one look into a class.
    """
    heads, tests = set(), []
    for literal in literals:
        at = next((i for i, c in enumerate(literal) if not (c.islower() or c == " ")), 0)
        heads.add(literal[at])
        tests.append(f"(?<={_quoted(literal[: at + 1])}){_quoted(literal[at + 1 :])}")
    return f"[{_quoted(''.join(sorted(heads)))}](?:{'|'.join(tests)})"


def worth_trying(rules: Sequence[Rule], line: Column) -> Column:
    """Cheap necessary condition for any of the rules to match on the line."""
    literals: dict[str, None] = {}
    guards: dict[str, None] = {}
    regexes: dict[str, None] = {}
    for rule in rules:
        if rule.sieve:
            literals.update(dict.fromkeys(rule.sieve))
        elif rule.guard:
            guards[f"(?:{to_java(rule.guard)})"] = None
        else:
            regexes[rule.java] = None
    # a longer literal is implied by a shorter one it contains
    wanted = [a for a in literals if not any(b != a and b in a for b in literals)]
    wanted.sort(key=len)
    plain = [a for a in wanted if a and a.isascii()]
    together = "|".join([any_literal(plain)] * bool(plain) + [*guards])
    tests = [F.rlike(line, F.lit(together))] if together else []
    tests += [F.contains(line, F.lit(a)) for a in wanted if a not in plain]
    return _any(tests + [F.rlike(line, F.lit(p)) for p in regexes])


def _keep_bytes(token: Column) -> Column:
    """Longest prefix of whole characters within ``KEEP_BYTES`` bytes."""
    prefixes = [F.substring(token, 1, n) for n in range(KEEP_BYTES, 0, -1)]
    return F.coalesce(*[F.when(F.octet_length(p) <= KEEP_BYTES, p) for p in prefixes], F.lit(""))


def redact_token(token: Column) -> Column:
    short = F.concat(_keep_bytes(token), F.lit(SHORTENED))
    return F.when(F.octet_length(token) > SHORTEN_ABOVE_BYTES, short).otherwise(F.lit(REDACTED))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit(rule: Rule, number: int, redact: bool) -> str:
    """SQL for the first match of ``rule`` on ``_line``: a struct, NULL without a match.

    The tests run left to right and stop at the first that fails.  SQL text is
    parsed in one go, which is much faster than composing the plan call by call.
    """
    tests = []
    if rule.env_only:
        tests.append("_env")
    if rule.gate:
        tests.append(f"_gate_{rule.gate}")
    if rule.anchors:
        subject = "_folded" if rule.folded else "_line"
        tests.append("(" + " OR ".join(f"contains({subject}, {_literal(a)})" for a in rule.anchors) + ")")
    if rule.guard:
        tests.append(f"_line RLIKE {_literal(to_java(rule.guard))}")
    tests.append(f"_line RLIKE {_literal(rule.java)}")
    if rule.allowlist is not None:
        tests.append(f"NOT (_line RLIKE {_literal(rule.java_allowlist)})")
    content = "_line"
    if redact:
        content = f"regexp_replace(_line, {_literal(first_match_prefix(rule.lead, rule.core))}, {_literal('$1' + REDACTED)})"
    return (
        f"CASE WHEN {' AND '.join(tests)} THEN named_struct("
        f"'rule_no', {number}, 'rule_name', {_literal(rule.name)}, 'severity', {_literal(rule.severity)}, "
        f"'severity_rank', {rank_of(rule.severity)}Y, "
        f"'_token', regexp_extract(_line, {_literal(f'{rule.lead}({rule.core})')}, 1), '_content', {content}) END"
    )


def _matches(rules: Sequence[Rule], with_env: bool, redact: bool) -> str:
    hits = [_hit(r, i, redact) for i, r in enumerate(rules) if (with_env or not r.env_only) and not r.runs_linear]
    if not hits:
        return (
            "CAST(NULL AS ARRAY<STRUCT<rule_no: INT, rule_name: STRING, severity: STRING, "
            "severity_rank: TINYINT, _token: STRING, _content: STRING>>)"
        )
    return f"array_compact(array({', '.join(hits)}))"


_FOUND = "rule_no int, rule_name string, severity string, severity_rank byte, _token string, _content string"


def _linear_hits(lines: DataFrame, rules: Sequence[Rule], line: str, redact: bool) -> DataFrame:
    """Hits of the rules that the linear-time engine runs: Arrow batches against its compiled patterns, no shuffle."""
    keep = [f for f in lines.schema.fields if f.name != line]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *T.StructType.fromDDL(_FOUND).fields])
    chosen = [
        (i, r.name, r.severity, rank_of(r.severity), r.linear, r.linear_allowlist) for i, r in enumerate(rules) if r.runs_linear
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name, severity, rank, linear, allowlist in chosen:
                at, parts = first_matches(batch.column(line), linear, allowlist)
                before, token, rest = (pc.struct_field(parts, k) for k in ("before", "hit", "rest"))
                shown = pa.repeat(REDACTED, len(at)) if redact else token
                told = [(number, pa.int32()), (name, pa.string()), (severity, pa.string()), (rank, pa.int8())]
                facts = [pa.array([value] * len(at), kind) for value, kind in told]
                content = pc.binary_join_element_wise(before, shown, rest, "")
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(names).take(at).columns, *facts, token, content], names=[f.name for f in schema.fields]
                )

    return lines.select(*names, line).mapInArrow(run, schema)


def explode_lines(df: DataFrame, text: str = "text", *, skip_blank: bool = False) -> DataFrame:
    """One row per line with a 1-based ``line_no``; the text column is replaced by ``line``."""
    keep = [c for c in df.columns if c != text]
    exploded = df.select(*keep, F.posexplode(split_lines(F.col(text))).alias("_pos", "line"))
    if skip_blank:
        exploded = exploded.filter(F.col("line") != "")
    return exploded.select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")


def match_rules(
    lines: DataFrame,
    rules: Sequence[Rule],
    *,
    line: str = "line",
    env: Column | None = None,
    redact: bool = True,
) -> DataFrame:
    """One row per (line, rule) with a match, from the rule's first match on the line.

    ``env`` says whether the line comes from an env-like file; without it the
    env-only rules do not take part.  The ``line`` column is replaced by
    ``rule_no, rule_name, severity, severity_rank, matched_text, line_content``.
    """
    keep = [c for c in lines.columns if c != line]
    text = F.col(line)
    backtracking = [r for r in rules if not r.runs_linear]
    worth = worth_trying([r for r in backtracking if not r.env_only], text)
    if env is not None:
        worth = worth | (env & worth_trying([r for r in backtracking if r.env_only], text))
    gates = sorted({r.gate for r in backtracking if r.gate})
    candidates = lines.filter(worth).select(
        *keep,
        text.alias("_line"),
        fold(text).alias("_folded"),
        (F.lit(False) if env is None else env).alias("_env"),
    )
    candidates = candidates.select("*", *[F.rlike("_folded", F.lit(GATES[g])).alias(f"_gate_{g}") for g in gates])
    hits = candidates.select(*keep, F.inline(F.expr(_matches(rules, env is not None, redact))))
    if len(backtracking) < len(rules):
        linear = _linear_hits(lines, rules, line, redact)
        hits = hits.select(*linear.columns).unionByName(linear) if backtracking else linear
    token = F.col("_token")
    return hits.select(
        *keep,
        "rule_no",
        "rule_name",
        "severity",
        "severity_rank",
        (redact_token(token) if redact else token).alias("matched_text"),
        trim_end(F.col("_content")).alias("line_content"),
    )


def scan_text(
    df: DataFrame,
    rules: Sequence[Rule],
    *,
    text: str = "text",
    env: Column | None = None,
    redact: bool = True,
) -> DataFrame:
    """Split a text column into lines and match the rules; other columns are carried along."""
    if env is not None:
        df = df.withColumn("_env_file", env)
    env_flag = F.col("_env_file") if env is not None else None
    return match_rules(explode_lines(df, text), rules, env=env_flag, redact=redact).drop("_env_file")
