"""Conversations as training texts with token masks that fit the assistant's words to the byte.

A conversation is rendered whole, ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed for every turn, and
encoded once by a byte-level BPE vocabulary. Token borders are byte offsets; the spans of assistant texts, ascending
like them, are met with the tokens by binary search. A token that lies across the border of a span is under
the mask, and the span says how many bytes of its first and last token are not its own, so that the text under the
mask can be read back exactly.

Control strings inside texts: ``<``, any number of backslashes and ``|`` get one backslash more, which undoes itself on
reading, so ``<|`` occurs in the template's own marks only. Roles moreover have their backslashes and line feeds escaped.

Rows of a conversation meet in one task, sorted, and stream through it. A conversation of more than ``PART_BYTES``
is dealt by ranges of its turns instead and rendered in several parts, cut between turns; no token lies across such a
cut, as the mark that opens a turn never joins the line feed before it. So a conversation may be of any length; only
its digest, one hash over all of it, is made in one stream.

Cases: rows come by turn (null first), then role, then MD5 of the text; equal rows stay. A null text or role is
empty. A null conversation id is an id of its own. An empty assistant text has no tokens. Any other role, whatever its
letter case, is not the assistant's. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.token_alignment import ByteBpe
from siftworks.session import staged

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PART_BYTES = 8 << 20
BATCH_BYTES = 1 << 18  # rendered before tokens are made and handed over

_BARE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_IN_ROLE = re.compile(r"\\(.)")

_SPAN = pa.struct([(name, pa.int32()) for name in ("first", "last", "skip", "drop")])
_FORMATTED = (
    "conv_id long, part long, formatted string, ids array<int>, loss_mask array<boolean>, "
    "spans array<struct<first int, last int, skip int, drop int>>"
)
_READ = "conv_id long, part long, n_turns long, turns string, loss string, formatted_chars long"
_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _BARE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _IN_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Rendered(NamedTuple):
    """A formatted text and the byte spans of assistant texts in it."""

    text: str
    spans: list[tuple[int, int]]


def render(turns: list[tuple[str, str]]) -> Rendered:
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == ASSISTANT:
            spans.append((start, end))
        pieces += (head, body, tail)
        at = end + len(tail)
    return Rendered("".join(pieces), spans)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def masked(lengths: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens, given by their bytes, meet a span; and for each span its first token, the one behind its
    last, and how many bytes of these two lie outside of it."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(ends, lo, "right")
    last = np.where(hi > lo, np.searchsorted(starts, hi, "left"), first)
    some = hi > lo
    skip, drop = np.zeros_like(lo), np.zeros_like(lo)
    skip[some] = lo[some] - starts[first[some]]
    drop[some] = ends[last[some] - 1] - hi[some]
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0, np.stack([first, last, skip, drop], axis=1)


def under_mask(coder: ByteBpe, ids: np.ndarray, mask: np.ndarray, spans: list[dict]) -> list[str]:
    """The assistant texts as the masked tokens spell them."""
    texts = []
    for span in spans:
        inside = slice(span["first"], span["last"])
        spelled = coder.tokens.spell(ids[inside][mask[inside]]).tobytes()
        texts.append(unescape(spelled[span["skip"] : len(spelled) - span["drop"]].decode()))
    return texts


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    borders = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.zeros(0, arrays[0].dtype if arrays else np.int64)])
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat, kind))


def _span_lists(spans: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*spans, np.zeros((0, 4), np.int64)])
    fields = [pa.array(flat[:, i], pa.int32()) for i in range(4)]
    borders = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
    return pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays(fields, fields=list(_SPAN)))


def _names(schema: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) (?![^<]*>)", schema)


def _encoded(coder: ByteBpe, rows: list[tuple[int | None, int, Rendered]]) -> pa.RecordBatch:
    ids = coder.encode([rendered.text for *_, rendered in rows])
    masks, spans = [], []
    for found, (*_, rendered) in zip(ids, rows, strict=True):
        lengths = coder.tokens.lengths[found]
        if lengths.sum() != len(rendered.text.encode()):
            raise ValueError("the vocabulary does not keep all bytes of a text")
        mask, span = masked(lengths, rendered.spans)
        masks.append(mask)
        spans.append(span)
    columns = [
        pa.array([conv for conv, *_ in rows], pa.int64()),
        pa.array([part for _, part, _ in rows], pa.int64()),
        pa.array([rendered.text for *_, rendered in rows], pa.string()),
        _lists(ids, pa.int32()),
        _lists(masks, pa.bool_()),
        _span_lists(spans),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "formatted", "ids", "loss_mask", "spans"])


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """Turns of sorted rows by conversation, cut where they reach ``PART_BYTES``."""
    conv, part, turns, size = None, 0, [], 0
    for batch in batches:
        for next_conv, at, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "at", "role", "text")], strict=True):
            own = len(text.encode()) + len(role.encode())
            if turns and (next_conv != conv or size + own > PART_BYTES):
                yield conv, part, turns
                turns, size = [], 0
            if not turns:
                conv, part = next_conv, at
            turns.append((role, text))
            size += own
    if turns:
        yield conv, part, turns


def format_conversations(rows: DataFrame, byte_bpe: bytes) -> DataFrame:
    """``(conv_id, part, whole, formatted, ids, loss_mask, spans)`` from ``rows(conv_id, turn, role, text)``.

    ``whole`` rows hold a conversation; of others, the parts of a conversation in the order of ``part`` do.
    ``loss_mask`` has one value for each token, ``spans`` one entry ``(first, last, skip, drop)`` for each assistant
    turn: its tokens, and the bytes at their ends that are not its own.
    """
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(byte_bpe)
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("text", "role"))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tie", F.md5("text"))
    order = ["conv_id", "turn", "role", "tie"]
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    sizes = turns.groupBy("conv_id").agg(size.alias("size"))
    long = staged(sizes.where(F.col("size") > PART_BYTES).select(F.col("conv_id").alias("long_id")), "long-conversations")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = ByteBpe(shipped.value), [], 0
        for conv, part, found in _in_parts(batches):
            held.append((conv, part, render(found)))
            size += len(held[-1][-1].text)
            if size >= BATCH_BYTES:
                yield _encoded(coder, held)
                held, size = [], 0
        if held:
            yield _encoded(coder, held)

    def formatted(dealt: DataFrame, whole: bool) -> DataFrame:
        stream = dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        made = stream.select("conv_id", "at", "role", "text").mapInArrow(run, _FORMATTED)
        return made.select("conv_id", "part", F.lit(whole).alias("whole"), "formatted", "ids", "loss_mask", "spans")

    if long.isEmpty():
        return formatted(turns.repartition("conv_id"), True)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = turns.join(long, same, "left_anti").repartition("conv_id")
    cut = turns.join(long, same, "left_semi").repartitionByRange(*order)
    return formatted(short, True).unionByName(formatted(cut, False))


def read_back(formatted: DataFrame, byte_bpe: bytes) -> DataFrame:
    """``(conv_id, part, n_turns, turns, loss, formatted_chars)`` of every formatted row.

    ``turns`` joins role, line feed, text and line feed of the turns that the text holds; ``loss`` is what the
    masked tokens spell, unescaped.
    """
    shipped = formatted.sparkSession.sparkContext.broadcast(byte_bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(shipped.value)
        for batch in batches:
            turns = [parse(text) for text in batch.column("formatted").to_pylist()]
            ids, masks = (batch.column(n) for n in ("ids", "loss_mask"))
            loss = [
                "".join(under_mask(coder, ids[i].values.to_numpy(), masks[i].values.to_numpy(zero_copy_only=False), spans))
                for i, spans in enumerate(batch.column("spans").to_pylist())
            ]
            columns = [
                batch.column("conv_id"),
                batch.column("part"),
                pa.array([len(x) for x in turns], pa.int64()),
                pa.array(["".join(f"{role}\n{text}\n" for role, text in x) for x in turns], pa.string()),
                pa.array(loss, pa.string()),
                pa.array([len(text) for text in batch.column("formatted").to_pylist()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_READ))

    return formatted.select("conv_id", "part", "formatted", "ids", "loss_mask", "spans").mapInArrow(run, _READ)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over the parts of each conversation, which come in order."""
    names = _names(_DIGESTS)
    open_, told = False, {}

    def row() -> pa.RecordBatch:
        ready = {**told, "turns_sha256": told["turns_sha256"].hexdigest(), "loss_sha256": told["loss_sha256"].hexdigest()}
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([ready[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        for part in batch.to_pylist():
            if open_ and part["conv_id"] != told["conv_id"]:
                yield row()
                open_ = False
            if not open_:
                told = {n: 0 for n in names} | {"conv_id": part["conv_id"]}
                told |= {"turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
                open_ = True
            told["n_turns"] += part["n_turns"]
            told["loss_chars"] += len(part["loss"])
            told["formatted_chars"] += part["formatted_chars"]
            told["turns_sha256"].update(part["turns"].encode())
            told["loss_sha256"].update(part["loss"].encode())
    if open_:
        yield row()


def conversation_digests(formatted: DataFrame, byte_bpe: bytes) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from the output."""
    whole = read_back(formatted.where("whole"), byte_bpe).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
    cut = read_back(formatted.where("NOT whole"), byte_bpe)
    parts = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(parts.mapInArrow(_hashed, _DIGESTS))
