"""Bounded-space online packing of documents into fixed windows of tokens.

Every task tokenises the documents that it scans, with one end id after each, and
keeps at most ``open_windows`` windows open.  What a document has beyond whole
windows goes to the fullest open window that holds it (best fit).  When none
does, the fullest is filled up with the start of the piece (or, if fewer than
``least_piece`` ids fit, padded) and emitted, and a new window opens.
Windows left open at the end of a task are merged: 64 tasks' leftovers at a time
go through the same packing, until one group is left.  Its last window is cut at
the powers of two of its length, which need no padding.

Each task holds ``open_windows`` windows and the pieces of one batch.  Nothing is
collected; the first pass is written to the shared folder so that tokenising
happens once.

A null or empty text is its end id alone.  Rows are packed one by one, repeated
ones too; a null id stays null.  An empty table gives an empty result.  Other
columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import Words
from docweave.scratch import saved

WINDOW, OPEN, LEAST, MERGED = 2048, 32, 16, 64
COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_open"]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, is_open boolean"
ARROW = pa.schema([(c, pa.binary() if c == "ids" else pa.bool_() if c == "is_open" else pa.int64()) for c in COLUMNS])
#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int | None, int, bytes, int]


class Packer:
    def __init__(self, first_sequence: int, window: int, open_windows: int, least_piece: int):
        self.sequence, self.window, self.most, self.least = first_sequence, window, open_windows, least_piece
        self.open: list[tuple[int, list[Piece]]] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.sequence, offset, is_open))
            offset += n
        self.sequence += 1

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        n = len(ids) // 4
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + self.window)], total)])
        if n > whole:
            self.place((doc, start + whole, ids[4 * whole :], total))

    def place(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        fits = [(used, k) for k, (used, _) in enumerate(self.open) if used + n <= self.window]
        if fits:
            used, k = max(fits)
            self.open[k] = (used + n, [*self.open[k][1], piece])
            if used + n == self.window:
                self.emit(self.open.pop(k)[1])
        elif len(self.open) < self.most:
            self.open.append((n, [piece]))
        else:
            used, k = max((used, k) for k, (used, _) in enumerate(self.open))
            pieces = self.open.pop(k)[1]
            gap = self.window - used
            if gap >= self.least:
                doc, start, ids, total = piece
                pieces.append((doc, start, ids[: 4 * gap], total))
                piece = (doc, start + gap, ids[4 * gap :], total)
            self.emit(pieces)
            self.place(piece)

    def leave(self) -> None:
        for _, pieces in self.open:
            self.emit(pieces, True)
        self.open = []

    def close(self) -> None:
        """Merges what is open, fullest first, and cuts the last window at powers of two."""
        self.most = 1
        rest, self.open = sorted(self.open, key=lambda w: w[0]), []
        for _, pieces in rest:
            for piece in pieces:
                self.least = 1
                self.place(piece)
        for used, pieces in self.open:
            bit = 1 << used.bit_length()
            while pieces:
                while bit > used:
                    bit >>= 1
                taken, need = [], bit
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    n = min(need, len(ids) // 4)
                    taken.append((doc, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                    need -= n
                self.emit(taken)
                used -= bit
        self.open = []

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def piece_encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a match of the split pattern by the tokenizer's own model, to which added tokens' strings are ordinary text."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path).model, byte_letters()

    def encode(piece: str) -> bytes:
        ids = [t.id for t in model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


@lru_cache(1)
def words_of(path: str, pattern: str) -> Words:
    """One per worker process."""
    return Words(pattern, piece_encoder(path), 400_000)


@lru_cache(1)
def added_token_encoder(path: str) -> Callable[[str], bytes | None]:
    """Ids by the whole tokenizer of a text that holds an added token (such as <|endoftext|>), None of another text."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes | None:
        if not any(a in text for a in added):
            return None
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def _first_pass(path: str, pattern: str, end: bytes, window: int, open_windows: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, special = words_of(path, pattern), added_token_encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window, open_windows, least)
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_py()
                ids = special(value or "")
                ids = (words.text(value) if ids is None else ids) + end
                packer.add((doc, 0, ids, len(ids) // 4))
                held += len(ids)
                if held > 1 << 24 and packer.out:
                    yield packer.rows()
                    held = 0
        packer.leave()
        if packer.out:
            yield packer.rows()

    return run


def _merge(window: int, open_windows: int, least: int, level: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        packer = Packer(level << 60 | key[0].as_py() << 40, window, open_windows, least)
        order = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, ids, total in zip(*(order[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add((doc, start, ids, total))
        if last:
            packer.close()
        else:
            packer.leave()
        return pa.Table.from_batches([packer.rows()]) if packer.out else ARROW.empty_table()

    return run


def pack(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN, least_piece: int = LEAST
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    first = saved(docs.mapInArrow(_first_pass(path, pattern, end, window, open_windows, least_piece), SCHEMA), "packed")
    done, rest, level = [first.where("NOT is_open")], first.where("is_open"), 1
    tasks = (rest.agg(F.max(F.expr("sequence_id >> 40"))).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // MERGED)
        group = F.expr("(sequence_id & ((1L << 60) - 1)) >> 40")
        merged = rest.groupBy(F.floor(group / MERGED).cast("long")).applyInArrow(_merge(window, open_windows, least_piece, level, tasks == 1), SCHEMA)
        merged = saved(merged, "packed")
        done.append(merged.where("NOT is_open"))
        if tasks == 1:
            break
        rest, level = merged.where("is_open"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.drop("is_open")
