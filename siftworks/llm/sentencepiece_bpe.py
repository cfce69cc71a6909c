"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

Encoding follows the model's own agenda: of all neighbouring symbols whose
concatenation is a piece, the best scored pair merges first, the leftmost of equals. With
dropout every candidate merge is left out by a keyed hash of its own, of the seed, the document, the stretch's
place in it, the merge's start in the stretch and the piece, so a text has many
segmentations, each of them reproducible, and a task that runs again gives the same one.

No piece holds a word border inside (checked when a model is loaded), so a text is cut
into stretches of spaces with the word after them, and the agendas of many stretches run side by side in
arrays. Every stretch has an agenda of its own. Characters that are no piece become byte pieces; so does the
character that stands for a space in pieces, which keeps decoding exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.words import mixed, slices, text_bytes

SPACE = "▁"
DROPOUT = 0.1
SLICE = 2 << 20  # bytes of text encoded at once
ROUND = 1 << 17  # bytes whose agendas run side by side
_NEVER = np.int32(2**31 - 1)


class Codec:
    """A SentencePiece BPE model as arrays."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = 0, variants: int | None = None):
        # ``variants`` once bounded the segmentations of a word; it is taken from older callers and bounds nothing
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = sp.get_piece_size()
        self.dropout, self.seed = dropout, seed
        names = [sp.id_to_piece(i) for i in range(count)]
        self.byte_ids = np.zeros(256, np.int64)
        self.decoded = [name.replace(SPACE, " ").encode() for name in names]
        self.ids: dict[str, int] = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                value = int(name[1:-1], 16)
                self.byte_ids[value], self.decoded[i] = i, bytes([value])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.decoded[i] = b""
            else:
                self.ids[name] = i
        if not all(self.byte_ids) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model needs byte pieces, and none with a space after another character")
        self.breaks = not any("\n" in p for p in self.ids)
        # symbols: pieces by id, then unknown characters
        self.unknown = count
        self.points = np.full(0x110000, -1, np.int32)
        for name, i in self.ids.items():
            if len(name) == 1 and name != SPACE:
                self.points[ord(name)] = i
        self.points[ord(" ")] = self.ids[SPACE]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        pairs = [
            (self.ids[p[:k]], self.ids[p[k:]], order[sp.get_score(i)], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        ]
        left, right, rank, piece = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._table(left << 32 | right, rank.astype(np.int32), piece)

    def _table(self, keys: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> None:
        """Open addressing: where each pair of symbols stands."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NEVER, np.int32)
        self.piece = np.zeros(1 << self.bits, np.int64)
        at, rest = self._start(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] < 0
            slot, first = np.unique(at[rest[free]], return_index=True)
            put = rest[free][first]
            self.keys[slot], self.rank[slot], self.piece[slot] = keys[put], rank[put], piece[put]
            rest = np.setdiff1d(rest, put)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot for those that are none."""
        at = self._start(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.keys[at[open_]] >= 0)]
        return at

    def merge(self, symbols: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run the agendas of many stretches at once.

        ``symbols`` with the stretch they belong to, in order, and a key for each
        stretch's dropout. Gives the symbols left, with their stretches.
        """
        place = np.arange(len(symbols)) - np.searchsorted(owner, owner)
        rank, piece = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        fresh = np.arange(len(symbols))  # symbols that have not met the one behind them yet
        done = []
        while len(symbols):
            rank[fresh] = _NEVER
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            slot = self._find(symbols[fresh] << 32 | symbols[fresh + 1])
            rank[fresh], piece[fresh] = self.rank[slot], self.piece[slot]
            if self.dropout:
                can = fresh[rank[fresh] != _NEVER]
                chance = mixed(keys[owner[can]] ^ mixed((place[can].astype(np.uint64) << np.uint64(32)) | piece[can].astype(np.uint64)))
                rank[can[chance < np.uint64(int(self.dropout * 2**64))]] = _NEVER
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best != _NEVER, size)
            done.append((symbols[~live], owner[~live]))
            hit = np.flatnonzero(live & (rank == np.repeat(best, size)))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])] if len(hit) else hit
            symbols[hit] = piece[hit]
            changed = np.zeros(len(symbols), bool)
            changed[hit] = changed[hit - 1] = True
            live[hit + 1] = False
            symbols, owner, place, rank, piece, changed = (x[live] for x in (symbols, owner, place, rank, piece, changed))
            fresh = np.flatnonzero(changed)
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbols, owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _stretches(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Starts of the stretches of all rows."""
        space = raw == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        if self.breaks:
            line = raw == 0x0A
            begin |= line
            begin[1:] |= line[:-1] & ~space[1:]
        begin[rows[:-1][rows[:-1] < len(raw)]] = True
        return np.flatnonzero(begin)

    def encode(self, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the border of each row in them; ``keys`` tell rows apart for dropout."""
        raw, rows = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        start = self._stretches(raw, rows)
        end = np.append(start[1:], len(raw))
        first = np.searchsorted(start, rows)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
        leads = np.zeros(len(start), np.int64)
        leads[first[:-1][np.diff(rows) > 0]] = 1  # the model puts a space before each text
        place = np.arange(len(start)) - first[:-1][row]
        drop_keys = mixed(mixed(keys[row] ^ mixed(place.astype(np.uint64))) ^ mixed(np.array([self.seed], np.int64).view(np.uint64)))
        ids, lengths, lo = [], [], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + ROUND, "right")))
            symbols, owner, others = self._symbols(raw, start[lo:hi], end[lo:hi], leads[lo:hi])
            left, owner = self.merge(symbols, owner, drop_keys[lo:hi])
            left, owner = self._with_bytes(left, owner, others)
            ids.append(left.astype(np.int32))
            lengths.append(np.bincount(owner, minlength=hi - lo))
            lo = hi
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])[first]

    def _symbols(self, raw, start, end, leads) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The characters of neighbouring stretches as symbols, with their stretches, and the unknown ones."""
        data = raw[start[0] : end[-1]]
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[end - start[0]]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        flat = self.points[points].astype(np.int64)
        strange = np.flatnonzero(flat < 0)
        unknown, number = np.unique(points[strange], return_inverse=True)
        flat[strange] = self.unknown + number
        begin = np.concatenate([[0], ends[:-1]])
        flat = np.insert(flat, begin[np.flatnonzero(leads)], self.ids[SPACE])
        return flat, np.repeat(np.arange(len(start)), ends - begin + leads), [chr(c).encode() for c in unknown.tolist()]

    def _with_bytes(self, symbols: np.ndarray, owner: np.ndarray, others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces."""
        if not others:
            return symbols, owner
        size = np.ones(len(symbols), np.int64)
        strange = symbols >= self.unknown
        width = np.array([len(x) for x in others])
        size[strange] = width[symbols[strange] - self.unknown]
        flat = self.byte_ids[np.frombuffer(b"".join(others), np.uint8)]
        begin = np.cumsum(width) - width
        out = np.repeat(symbols, size)
        within = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        odd = out >= self.unknown
        out[odd] = flat[begin[out[odd] - self.unknown] + within[odd]]
        return out, np.repeat(owner, size)

    def decode(self, ids) -> str:
        """The text of one row's ids."""
        pieces = self.decoded
        return b"".join([pieces[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_texts(
    docs: DataFrame, model: bytes, dropout: float = DROPOUT, seed: int = 0, variants: int | None = None
) -> DataFrame:
    """``(doc_id, ids, n_ids, lossless)`` for each row of ``docs (doc_id, text)``; ``lossless``: the ids decode to the text.

    A null or empty text has no ids and decodes to the empty text. Rows with one
    id and text get the same ids whenever they are encoded with one seed; a null id is an id of its own
    kind. Texts are never cut. Other columns are ignored, an empty table gives an empty table.
    The model travels to the tasks as bytes, so executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, dropout, seed, variants)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                names = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                ids, borders = codec.encode(batch.column("text"), mixed(names.astype(np.int64).view(np.uint64)))
                rows = [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                same = [codec.decode(x) == t for x, t in zip(rows, batch.column("text").to_pylist(), strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "ids": pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())),
                        "n_ids": pa.array(np.diff(borders), pa.int64()),
                        "lossless": pa.array(same, pa.bool_()),
                    }
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def decode_texts(encoded: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids are the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, 0.0)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
