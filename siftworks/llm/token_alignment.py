"""Alignment of two tokenizations of the same texts by products of sparse incidence matrices.

Every text is encoded whole by a byte-level BPE vocabulary (A, of a space and the text) and by a
SentencePiece model (B, of the text; the model puts the space there). Both cover the same bytes, so each is
a matrix of tokens times bytes, held as CSR rows built by hand. The row products of A with B transposed
(Gustavson's method: a row of the result is the sum of the B rows that the A row meets) give the overlap links, each
with the number of bytes shared. Overlap links whose tokens end at the same byte cut both tokenizations into groups;
products of the matrices of tokens times groups give the links between all tokens of a group. Texts of a slice stand
side by side, which makes the matrices block-diagonal, and byte columns are taken in blocks, so that no
array grows with more than a slice.

Corpus-wide counts of linked id pairs never need a row for every link: each task numbers the distinct pairs of
a block of texts, rows carry these numbers, and only the blocks' pair lists are summed up, compared and
brought back. There are at most (ids of A) x (ids of B) pairs, however large the corpus is.

Cases: texts that are null or empty, or whose tokens do not spell a space and the text (SentencePiece turns the
character U+2581 into a space, say), have no tokens and so no groups and links. Text that looks like a special
token is plain text. Repeated rows count each for themselves; ids may be null or repeat. No rows give no rows.
Other columns may have any name. One text's list of groups is one string, so a text may have some 400 MB.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.words import slices, text_bytes
from siftworks.session import staged

SLICE = 1 << 20  # bytes of text encoded and multiplied at once
COLUMNS = 1 << 20  # byte columns of one step of a product
BLOCK = 16 << 20  # bytes of text that share a numbering of pairs
ENCODE = 1 << 18
KINDS = ("overlap", "end", "group")

_ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, "
    "groups string, links array<int>, pairs array<long>, hits array<long>"
)
_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups_sha256 string"
_LINKS = "doc_id long, a_at long, b_at long, a_id int, b_id int, weight int"


class Csr(NamedTuple):
    """A sparse 0/1 or counting matrix by rows; ``values`` None stands for ones."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))


def from_entries(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> Csr:
    """Ones at the given places, which must come row by row."""
    return Csr(np.append(0, np.cumsum(np.bincount(rows, minlength=shape[0]))), columns, shape[1])


def transposed(matrix: Csr) -> Csr:
    rows, columns = matrix.rows, matrix.columns
    if (columns[1:] < columns[:-1]).any():
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
    return from_entries(columns, rows, (matrix.width, len(matrix.starts) - 1))


def product(a: Csr, b: Csr) -> Csr:
    """Row by row: each entry (i, k) of ``a`` adds row k of ``b`` to row i of the result."""
    met, entry = np.diff(b.starts)[a.columns], b.starts[a.columns]
    row = a.rows
    if (met != 1).any():
        ends = np.cumsum(met)
        row = np.repeat(row, met)
        entry = np.repeat(entry - ends + met, met) + np.arange(len(row))
    column = b.columns[entry]
    if ((row[1:] == row[:-1]) & (column[1:] < column[:-1])).any():
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    at = np.flatnonzero(fresh)
    found = from_entries(row[at], column[at], (len(a.starts) - 1, b.width))
    return found._replace(values=np.diff(np.append(at, len(row))))


def _token_bytes(ends: np.ndarray, lo: int, hi: int) -> tuple[int, Csr]:
    """The first token that meets the bytes from ``lo`` to ``hi``, and the matrix of those that do."""
    first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
    starts = np.concatenate([[lo], np.minimum(ends[first : last + 1], hi)]) - lo
    return int(first), Csr(starts, np.arange(hi - lo, dtype=np.int32), hi - lo)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and shared bytes of each pair that overlaps, in order; both cover the same bytes."""
    parts, total = [], int(a_ends[-1]) if len(a_ends) else 0
    for lo in range(0, total, COLUMNS):
        hi = min(lo + COLUMNS, total)
        (a_first, a), (b_first, b) = _token_bytes(a_ends, lo, hi), _token_bytes(b_ends, lo, hi)
        found = product(a, transposed(b))
        rows, columns, shared = found.rows.astype(np.int64) + a_first, found.columns.astype(np.int64) + b_first, found.values
        if parts and parts[-1][0][-1] == rows[0] and parts[-1][1][-1] == columns[0]:
            parts[-1][2][-1] += shared[0]  # a pair across the border of two column blocks
            rows, columns, shared = rows[1:], columns[1:], shared[1:]
        if len(rows):
            parts.append((rows, columns, shared))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def group_links(a_group: np.ndarray, b_group: np.ndarray, entries: int = COLUMNS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of an A and a B token of one group, as products of the token-group matrices in blocks of A tokens.

    A block's product has at most about ``entries`` links, or those of a single token.
    """
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    b = transposed(from_entries(np.arange(len(b_group)), b_group, (len(b_group), groups)))
    made = np.cumsum(np.diff(b.starts)[a_group])
    lo = 0
    while lo < len(a_group):
        before = made[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(made, before + entries, "right")))
        found = product(from_entries(np.arange(hi - lo), a_group[lo:hi], (hi - lo, groups)), b)
        yield found.rows + lo, found.columns
        lo = hi


def read_vocabularies(byte_bpe: str, pieces: str) -> tuple[bytes, bytes]:
    """Both files as bytes, read on the driver; they are a few MB."""
    with open(byte_bpe, "rb") as a, open(pieces, "rb") as b:
        return a.read(), b.read()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Tokens:
    """The bytes of every id, and ids written as decimals."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.names = pa.array([str(i) for i in range(len(spelled))])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


# Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# white space that long is more than the quick engine's regex can go back over
_LONG_BLANK = re.compile(r"\s{10000}")


class ByteBpe:
    """A byte-level BPE tokenizer; its special tokens are plain text inside texts.

    Where the vocabulary's ids follow the order of its merges, a quicker engine gives the same tokens; texts with
    very long white space go through the other one.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet, parts = byte_alphabet(), json.loads(model)
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in parts["model"]["vocab"].items()
            if all(c in alphabet for c in token)
        }
        spelled = [b""] * self.tokenizer.get_vocab_size()
        for token, i in ranks.items():
            spelled[i] = token
        self.tokens = Tokens(spelled)
        self.quick = self._quick_engine(parts, ranks)

    @staticmethod
    def _quick_engine(parts: dict, ranks: dict[bytes, int]):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        merged = np.array([parts["model"]["vocab"][a + b] for a, b in pairs])
        cut = parts["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if parts["normalizer"] or not plain or (np.diff(merged) <= 0).any() or len(ranks) != 256 + len(merged):
            return None
        import tiktoken

        return tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _encode_one(self, text: str) -> np.ndarray:
        if self.quick is None or (len(text) >= 10_000 and _LONG_BLANK.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        return self.quick.encode_to_numpy(text).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode_one(text) for text in texts]


class Pieces:
    """A SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                spelled.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                spelled.append(b"")
            else:
                spelled.append(piece.replace("▁", " ").encode())
        self.tokens = Tokens(spelled)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Aligned(NamedTuple):
    """The texts of a slice side by side: ids of both kinds, row borders in them, and links of tokens that end together."""

    a: np.ndarray
    b: np.ndarray
    a_rows: np.ndarray
    b_rows: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]
    link_a: np.ndarray
    link_b: np.ndarray
    link_rows: np.ndarray


def _spelled_alike(tokens: Tokens, ids: list[np.ndarray], wanted: list[bytes]) -> list[bool]:
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    found, ends = tokens.spell(flat).tobytes(), np.cumsum([0, *[int(tokens.lengths[x].sum()) for x in ids]])
    return [found[lo:hi] == w for lo, hi, w in zip(ends[:-1], ends[1:], wanted, strict=True)]


def _encoded(coder: ByteBpe | Pieces, texts: list[str]) -> list[np.ndarray]:
    """In small portions, as an encoding takes many times the memory of its text."""
    result, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= ENCODE:
            result += coder.encode(held)
            held, size = [], 0
    return result + (coder.encode(held) if held else [])


def align_texts(byte_bpe: ByteBpe, pieces: Pieces, texts: list[str | None]) -> Aligned:
    at = [i for i, text in enumerate(texts) if text]
    spaced = [" " + texts[i] for i in at]
    wanted = [x.encode() for x in spaced]
    a, b = _encoded(byte_bpe, spaced), _encoded(pieces, [texts[i] for i in at])
    good = zip(_spelled_alike(byte_bpe.tokens, a, wanted), _spelled_alike(pieces.tokens, b, wanted), strict=True)
    kept = [k for k, both in enumerate(good) if all(both)]
    none = [np.zeros(0, np.int64)]
    a_ids, b_ids = (np.concatenate([x[k] for k in kept] + none) for x in (a, b))
    counts = np.zeros((2, len(texts) + 1), np.int64)
    for k in kept:
        counts[:, at[k] + 1] = len(a[k]), len(b[k])
    a_rows, b_rows = np.cumsum(counts, axis=1)
    a_ends, b_ends = np.cumsum(byte_bpe.tokens.lengths[a_ids]), np.cumsum(pieces.tokens.lengths[b_ids])
    overlaps = overlap_links(a_ends, b_ends)
    together = a_ends[overlaps[0]] == b_ends[overlaps[1]]
    link_a, link_b = overlaps[0][together], overlaps[1][together]
    return Aligned(a_ids, b_ids, a_rows, b_rows, overlaps, link_a, link_b, np.searchsorted(link_a, a_rows))


def groups_of(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B token: the first link that is not before it closes its group."""
    return (
        np.searchsorted(found.link_a, np.arange(len(found.a))),
        np.searchsorted(found.link_b, np.arange(len(found.b))),
    )


def group_texts(byte_bpe: ByteBpe, pieces: Pieces, found: Aligned) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for every row."""

    def lists(tokens: Tokens, ids: np.ndarray, last: np.ndarray) -> pa.Array:
        borders = pa.array(np.concatenate([[0], last + 1]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(borders, tokens.names.take(pa.array(ids))), ",")

    groups = pc.binary_join_element_wise(
        lists(byte_bpe.tokens, found.a, found.link_a), lists(pieces.tokens, found.b, found.link_b), "|"
    )
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(found.link_rows, pa.int32()), groups), ";")


class PairNumbers:
    """Numbers distinct keys in order of appearance and counts them."""

    def __init__(self):
        self.keys = np.zeros(0, np.int64)  # ascending
        self.numbers = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)  # by number

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key."""
        distinct, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        numbers = np.empty(len(distinct), np.int64)
        numbers[known] = self.numbers[at[known]]
        numbers[~known] = len(self.counts) + np.arange(np.count_nonzero(~known))
        self.counts = np.concatenate([self.counts, np.zeros(np.count_nonzero(~known), np.int64)])
        self.counts[numbers] += counts
        self.keys = np.insert(self.keys, at[~known], distinct[~known])
        self.numbers = np.insert(self.numbers, at[~known], numbers[~known])
        return numbers[place]

    def by_number(self) -> np.ndarray:
        keys = np.empty_like(self.keys)
        keys[self.numbers] = self.keys
        return keys


def align(docs: DataFrame, vocabularies: tuple[bytes, bytes], *, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs(<id>, text)``, and one for each block of texts.

    Rows: ``doc_id, n_a, n_b, n_groups, n_links`` (links of tokens that end together), ``n_overlaps`` (links of
    tokens that share a byte), ``n_shared`` (links of tokens of one group), ``groups`` (``a1,a2|b1;a3|b2,b3``)
    and ``links``, numbers into the block's pair list. Blocks: a row with only ``block``, ``pairs``
    (``a << 32 | b`` by number) and ``hits`` (how often each is linked in the block).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_bpe, pieces = ByteBpe(shipped.value[0]), Pieces(shipped.value[1])
        block, numbers, held = TaskContext.get().partitionId() << 33, PairNumbers(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = align_texts(byte_bpe, pieces, part.column("text").to_pylist())
                yield _row_batch(block, part.column("id"), found, group_texts(byte_bpe, pieces, found), numbers)
                held += len(text_bytes(part.column("text"))[0])
                if held >= BLOCK:
                    yield _block_batch(block, numbers)
                    block, numbers, held = block + 1, PairNumbers(), 0
        yield _block_batch(block, numbers)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def _row_batch(block: int, ids: pa.Array, found: Aligned, groups: pa.Array, numbers: PairNumbers) -> pa.RecordBatch:
    n, per_row = len(ids), lambda borders: pa.array(np.diff(borders))
    keys = found.a[found.link_a] << 32 | found.b[found.link_b]
    a_last, b_last = np.append(-1, found.link_a), np.append(-1, found.link_b)
    shared = np.append(0, np.cumsum(np.diff(a_last) * np.diff(b_last)))
    overlaps = np.searchsorted(found.overlaps[0], found.a_rows)
    links = pa.ListArray.from_arrays(pa.array(found.link_rows, pa.int32()), pa.array(numbers.add(keys), pa.int32()))
    none = pa.nulls(n, pa.list_(pa.int64()))
    count = per_row(found.link_rows)
    columns = [
        pa.array(np.full(n, block)), ids, per_row(found.a_rows), per_row(found.b_rows), count, count, per_row(overlaps),
        per_row(shared[found.link_rows]), groups, links, none, none,
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names(_ROWS))


def _block_batch(block: int, numbers: PairNumbers) -> pa.RecordBatch:
    long, lists = pa.int64(), pa.list_(pa.int64())
    none = [pa.nulls(1, long)] * 7
    pairs, hits = pa.array([numbers.by_number()], lists), pa.array([numbers.counts], lists)
    columns = [pa.array([block], long), *none, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pairs, hits]
    return pa.RecordBatch.from_arrays(columns, names=_names(_ROWS))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def count_links(aligned: DataFrame) -> DataFrame:
    """Rows of ``align`` with ``n_best`` and ``count_sum``, from corpus-wide counts of linked id pairs.

    ``count_sum`` adds up, over a row's links, how many links of the whole input hold the same pair of ids;
    ``n_best`` counts those links whose count is the highest among the pairs of their B id. ``groups`` comes as
    its SHA-256 (empty without tokens). The input is stored once, without the texts of groups.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    kept = staged(aligned.withColumn("groups_sha256", digest).drop("groups"), "alignment")
    rows = kept.where("pairs IS NULL")
    one = F.posexplode(F.arrays_zip("pairs", "hits")).alias("nth", "_one")
    entries = kept.where("pairs IS NOT NULL").select(F.col("block").alias("of_block"), one)
    entries = entries.select("of_block", "nth", "_one.pairs", "_one.hits")
    totals = entries.groupBy("pairs").agg(F.sum("hits").alias("total"))
    totals = staged(totals.withColumn("b_id", F.col("pairs").bitwiseAND((1 << 32) - 1)), "alignment-pairs")
    most = totals.groupBy("b_id").agg(F.max("total").alias("most"))
    judged = totals.join(most, "b_id").select("pairs", "total", (F.col("total") == F.col("most")).alias("best"))
    known = entries.join(judged, "pairs").select("of_block", "nth", "total", "best")
    names = _names(_SCORED)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        nth = right.column("nth").to_numpy()
        total, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
        total[nth], best[nth] = right.column("total").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        links = left.column("links").combine_chunks()
        links = pa.concat_arrays(links.chunks) if isinstance(links, pa.ChunkedArray) else links
        flat, borders = links.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(links).to_numpy()))
        sums = [np.diff(np.append(0, np.cumsum(x[flat]))[borders]) for x in (best, total)]
        return pa.table([*[left.column(n) for n in names], *[pa.array(x) for x in sums]], names=[*names, "n_best", "count_sum"])

    both = rows.groupBy("block").cogroup(known.groupBy("of_block"))
    return both.applyInArrow(score, _SCORED + ", n_best long, count_sum long")


def link_table(docs: DataFrame, vocabularies: tuple[bytes, bytes], kind: str = "end", *, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, a_at, b_at, a_id, b_id, weight)``: the links themselves, tokens numbered from 0 within a row.

    ``kind``: tokens that ``overlap``, ``end`` at the same byte, or belong to one ``group``. ``weight`` is the
    number of shared bytes for ``overlap`` and else 1. Links of a group grow with the product of its tokens.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    shipped = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_bpe, pieces = ByteBpe(shipped.value[0]), Pieces(shipped.value[1])
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = align_texts(byte_bpe, pieces, part.column("text").to_pylist())
                if kind == "group":
                    made = ((a, b, None) for a, b in group_links(*groups_of(found)))
                else:
                    made = [found.overlaps if kind == "overlap" else (found.link_a, found.link_b, None)]
                for a, b, weight in made:
                    row = np.searchsorted(found.a_rows, a, "right") - 1
                    columns = [
                        part.column("id").take(pa.array(row)),
                        pa.array(a - found.a_rows[row]),
                        pa.array(b - found.b_rows[row]),
                        pa.array(found.a[a], pa.int32()),
                        pa.array(found.b[b], pa.int32()),
                        pa.array(np.ones(len(a)) if weight is None else weight, pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=_names(_LINKS))

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _LINKS)
