"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers turn the words of a clause into symbols: insult, threat,
target, negation, reported speech. A grammar automaton reads the symbols, keeps
what a negation or a reporting verb still covers and whether a target is near, and gives each insult or
threat a context. The clause's score is the sum of the weights of what it matched;
words outside a matched clause count for nothing.

The insult transducer is learnt: words, and word beginnings shared by many words, that
stand in toxic texts far more often than in others. A beginning that clean texts hold
now and then counts only beyond what a text of that length holds by chance. What a context
is worth is learnt too; the fixed lists below only name the contexts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.quality import labelled_sample, learning_rows
from siftworks.llm.words import mixed, row_shingles, slices
from siftworks.session import staged

SAMPLE_ROWS = 20_000
MOST_STEMS = 4096
SHORTEST, LONGEST = 3, 12
MIN_TEXTS, MIN_SHARE = 4, 0.01
MIN_WEIGHT = 2.5
END = "$"  # marks a whole word; letters never hold it

# Closed word classes in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself he him she her they them their people du dich dir dein deine ihr euch sie er ihn "
    "tu toi te ton ta vous votre il elle eux tú ti usted ustedes él ella ellos ellas vosotros".split()
)
NEGATIONS = frozenset(
    "not no never none nobody nothing neither nor without isn't aren't wasn't don't doesn't didn't "
    "nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás sin ningún ninguna".split()
)
REPORTS = frozenset(
    "said says say called calls wrote writes claimed claims quoted reported told sagte sagt schrieb nannte behauptete "
    "dit disait écrit appelé affirme dijo dice escribió llamó afirma".split()
)
THREATS = frozenset(
    "kill hurt destroy murder stab shoot beat burn töten umbringen erschlagen tuer frapper détruire matar golpear destruir".split()
)
CONTEXTS = ("plain", "aimed", "negated", "reported")
# what a context is worth beside a plain insult where the labels show too few cases to tell
DEFAULT_FACTOR = {"plain": 1.0, "aimed": 1.2, "negated": 0.3, "reported": 0.4}
THREAT_WEIGHT = 4.0
REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
_BORDER = re.compile(r"[.!?;\n]")


@dataclass
class Grammar:
    """The learnt part: stems with weights and clean rates a word, the worth of contexts, the score without a match."""

    stems: dict[str, tuple[float, float]] = field(default_factory=dict)
    factor: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_FACTOR))
    prior: float = -2.0
    floor: float = 0.05


def automaton(stems: dict[str, tuple[float, float]]):
    """The insult and threat transducer as one machine over letters."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    forms: dict[str, list[tuple[str, bool, float, str]]] = {}
    for stem, (weight, _) in stems.items():
        forms.setdefault(stem.removesuffix(END), []).append(("insult", stem.endswith(END), weight, stem))
    for word in THREATS:
        forms.setdefault(word, []).append(("threat", True, THREAT_WEIGHT, ""))
    for form, readings in forms.items():
        machine.add_word(form, (form, readings))
    machine.make_automaton()
    return machine


Mark = tuple[str, float, str]
Event = tuple[int, str, str, float, str]


def marked_words(lowered: str, machine) -> dict[int, Mark]:
    """Start of each word that the insult or threat transducer accepts, with the kind, weight and stem of its best reading."""
    found: dict[int, Mark] = {}
    for last, (form, readings) in machine.iter(lowered):
        start, after = last - len(form) + 1, last + 1
        if start and lowered[start - 1].isalpha():
            continue
        ends = after >= len(lowered) or not lowered[after].isalpha()
        for kind, whole, weight, stem in readings:
            if (ends or not whole) and (start not in found or weight > found[start][1]):
                found[start] = kind, weight, stem
    return found


def read_clause(lowered: str, lo: int, hi: int, marked: dict[int, Mark]) -> list[tuple[str, str, float, str]]:
    """``(kind, context, weight, stem)`` for each insult or aimed threat in one clause."""
    negated = aimed = 0
    reported = quoted = False
    events, waiting = [], []
    for word in _WORD.finditer(lowered, lo, hi):
        at, form = word.start(), word.group()
        negated, aimed = max(0, negated - 1), max(0, aimed - 1)
        if at in marked:
            kind, weight, stem = marked[at]
            context = "negated" if negated else "reported" if reported or quoted else "aimed" if aimed else "plain"
            if kind == "insult" or context != "plain":
                events.append([kind, context, weight, stem])
            if context == "plain":
                waiting.append((len(events) - 1 if kind == "insult" else None, weight, REACH))
        elif form in NEGATIONS:
            negated = REACH + 1
        elif form in REPORTS:
            reported = True
        elif form in TARGETS:
            aimed = REACH + 1
            for place, weight, left in waiting:  # a target right after it aims an insult or threat too
                if left and place is None:
                    events.append(["threat", "aimed", weight, ""])
                elif left:
                    events[place][1] = "aimed"
            waiting = []
        elif not form[0].isalpha():
            quoted = not quoted
        waiting = [(p, w, left - 1) for p, w, left in waiting if left > 1]
    return [tuple(x) for x in events]


def text_events(lowered: str, machine) -> list[Event]:
    """``(clause start, kind, context, weight, stem)`` of all matches in a whole lower-case text."""
    marked = marked_words(lowered, machine)
    events, done = [], -1
    for at in sorted(marked):
        if at < done:
            continue
        lo = max((lowered.rfind(c, 0, at) for c in ".!?;\n")) + 1
        border = _BORDER.search(lowered, at)
        done = border.end() if border else len(lowered)
        events += [(lo, *e) for e in read_clause(lowered, lo, done, marked)]
    return events


def text_score(events: list[Event], words: int, grammar: Grammar) -> float:
    """Chance that a text of so many words with these matched clauses is toxic; ``floor`` without any."""
    count = Counter(e[4] for e in events)
    share = {}
    for stem, k in count.items():
        usual = words * grammar.stems[stem][1] if stem else 0.0
        share[stem] = max(0.0, 1 - (usual + 2 * sqrt(usual)) / k)
    total = sum(weight * grammar.factor[context] * share[stem] for _, _, context, weight, stem in events)
    return max(grammar.floor, 1 / (1 + exp(max(-30.0, min(30.0, -grammar.prior - total))))) if total > 0 else grammar.floor


def _distinct_texts(sample: DataFrame) -> DataFrame:
    """The sample without most near copies: of texts with the same smallest shingle, one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(row_shingles(batch.column("text")))
                first = pa.array([int(x.min()) >> 1 if len(x) else 0 for x in sets], pa.int64())
                second = pa.array([int(mixed(x).min()) >> 1 if len(x) else 0 for x in sets], pa.int64())
                yield batch.append_column("first", first).append_column("second", second)

    keyed = sample.select("doc_id", "label", "text").mapInArrow(
        run, "doc_id long, label int, text string, first long, second long"
    )
    lone = keyed.groupBy("label", "first").agg(F.min_by(F.struct("doc_id", "text", "second"), "doc_id").alias("x"))
    lone = lone.groupBy("label", "x.second").agg(F.min_by("x", "x.doc_id").alias("x"))
    return lone.select("x.doc_id", "label", "x.text")


def choose_stems(
    counts: dict[str, tuple[int, int]], toxic: int, others: int, words: int
) -> dict[str, tuple[float, float]]:
    """Stems that tell toxic texts from others, with weights and how often a word of other texts has them.

    A weight is the log ratio of the shares of texts, less its standard error. The
    strongest come first; a shorter stem then counts without the texts of the longer ones chosen.
    """

    left = dict(counts)

    def weight(stem: str) -> float:
        a, b = left[stem]
        return log((a + 0.5) / (toxic + 1)) - log((b + 0.5) / (others + 1)) - sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    chosen: dict[str, float] = {}
    for stem in sorted(counts, key=lambda s: (-weight(s), -len(s), s)):
        covered = any(stem[:k] in chosen for k in range(SHORTEST, len(stem)))
        if covered or stem in chosen or left[stem][0] < MIN_TEXTS or weight(stem) < MIN_WEIGHT:
            continue
        chosen[stem] = weight(stem)
        for k in range(SHORTEST, len(stem)):  # a shorter one stands for its other words only
            if stem[:k] in left:
                a, b = left[stem[:k]]
                left[stem[:k]] = max(0, a - left[stem][0]), max(0, b - left[stem][1])
    return {stem: (w, (counts[stem][1] + 0.5) / max(1, words)) for stem, w in chosen.items()}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Grammar:
    """The grammar from at most ``rows`` labelled learning rows; without toxic ones the fixed lists alone."""
    sample = staged(_distinct_texts(labelled_sample(docs, labels, label, rows)), "sample")
    length = F.sum(F.size(F.split("text", " ")))
    total = {r["label"]: (r["n"], r["words"]) for r in sample.groupBy("label").agg(F.count("*").alias("n"), length.alias("words")).collect()}
    (toxic, _), (others, clean_words) = total.get(1, (0, 0)), total.get(0, (0, 0))
    grammar = Grammar(prior=log((toxic + 0.5) / (others + 0.5)), floor=0.5 / (toxic + others + 1))
    if not toxic:
        return grammar
    words = sample.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    words = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("others"))
    marked = F.concat("word", F.lit(END))
    stems = F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.char_length(marked), F.lit(LONGEST))), lambda n: F.substring(marked, F.lit(1), n)
    )
    least = max(MIN_TEXTS, int(MIN_SHARE * toxic))
    # a beginning's counts add up those of its words, so a text with two such words counts twice on both sides
    counts = (
        words.where(F.char_length("word") >= SHORTEST)
        .withColumn("stem", F.explode(F.array_distinct(F.concat(stems, F.array(marked)))))
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
        .where((F.col("toxic") >= least) & (F.col("toxic") * others >= 4 * F.col("others") * toxic))
        .orderBy(F.desc(F.expr("toxic / (others + 1)")), "stem")
        .limit(MOST_STEMS)
        .collect()
    )
    grammar.stems = choose_stems({r["stem"]: (r["toxic"], r["others"]) for r in counts}, toxic, others, clean_words)
    return _with_contexts(sample, grammar, toxic, others)


def _with_contexts(sample: DataFrame, grammar: Grammar, toxic: int, others: int) -> Grammar:
    """What each context is worth beside a plain insult, where the labels show enough cases."""
    stems = grammar.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(stems)
        for batch in batches:
            seen = [
                (mark, context)
                for text, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)
                for context in {e[2] for e in text_events(text.lower(), machine) if e[1] == "insult"}
            ]
            yield pa.record_batch(
                {"label": pa.array([x[0] for x in seen], pa.int32()), "context": pa.array([x[1] for x in seen], pa.string())}
            )

    found = sample.select("label", "text").mapInArrow(run, "label int, context string").groupBy("context").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")
    )
    seen = {r["context"]: (r["toxic"], r["n"] - r["toxic"]) for r in found.collect()}
    worth = {c: log((a + 0.5) / (toxic + 1)) - log((b + 0.5) / (others + 1)) for c, (a, b) in seen.items() if a + b >= 5}
    for context, value in worth.items():
        if worth.get("plain", 0) > 0:
            # half as often or twice as often as a plain one is chance; only a clear difference changes the worth
            ratio = value / worth["plain"]
            grammar.factor[context] = 1.0 if ratio >= 0.5 else max(0.0, ratio)
    return grammar


def score(docs: DataFrame, grammar: Grammar, least: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_clauses)`` for each row's whole text.

    A null or empty text has no clause and gets the grammar's floor. Repeated rows
    get one answer; a null id is not held out. Other columns are ignored; an empty
    table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(grammar.stems)
        for batch in batches:
            scores, clauses = [], []
            for text in batch.column("text"):
                lowered = (text.as_py() or "").lower()
                events = text_events(lowered, machine)
                scores.append(text_score(events, lowered.count(" ") + 1, grammar))
                clauses.append(len({e[0] for e in events}))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(scores, pa.float64()),
                    "n_clauses": pa.array(clauses, pa.int64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_clauses long").select(
        "doc_id",
        F.coalesce(~learning_rows(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
        "n_clauses",
    )
