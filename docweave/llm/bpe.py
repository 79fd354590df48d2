"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into the matches of the split pattern, which are encoded apart.  A
match's bytes are encoded as a tree: halves recursively down to ``LEAF`` bytes,
then neighbours are joined.

The join rests on one fact about rank-ordered merging: a sequence of tokens is
the encoding of its bytes exactly if every two neighbours are the encoding of
theirs.  If the last token left and the first token right pass that test, the
runs are concatenated.  Otherwise the bytes of a window around the boundary are
encoded anew, and the window grows fourfold on each side whose edge fails the
test, until both edges pass; the tokens outside are then proven stable.  The join is
associative, with the empty run as its unit.  A window is encoded rank by rank in
time linear in its bytes but for sorting, and equal halves of a match are encoded
once, so that a run of one letter costs no more than other text.

Words recur, so a worker keeps the ids of the first ``CACHE`` words and of as many
recent matches; this bounds its memory and changes no result.  Decoding concatenates
the bytes of id runs up a tree.

Null and empty texts have no ids; their decoded bytes are empty.  Rows are
independent, so repeated rows and empty tables need no care; a match of n bytes costs
about n log n.  Other columns pass through, and columns of the output's names are replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

LEAF, SHORT = 64, 128
CACHE = 300_000
RUN = 4096
SLICE = 512
#: Unicode's White_Space: fixed values
WHITE = r"\t-\r \x85\xa0  -     　"
#: white space that a cut before a single space could tear
TORN = regex.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def compiled_pattern(pattern: str) -> regex.Pattern:
    """The pattern with Unicode's White_Space for its white space, as the libraries have it."""
    return regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Pieces(dict):
    """Matches of the split pattern to their ids, as little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHE):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Words(dict):
    """Words of a text, cut before single spaces, to their ids.

    The split pattern's matches start at every space that stands between other
    characters, so such words can be encoded apart and looked up whole.
    """

    def __init__(self, pattern: str, encode: Callable[[str], bytes], limit: int = CACHE):
        super().__init__()
        self.cut, self.pieces, self.limit = compiled_pattern(pattern), Pieces(encode, limit), limit

    def matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one match
            out = self.pieces[" " + word]
        else:
            out = self.matches(" " + word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if TORN.search(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return self.matches(first) + b"".join(map(self.__getitem__, rest))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable = lru_cache(100_000)(self._stable)
        self.words = Words(pattern, self.encode_match)

    def leaf(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        if len(data) > SHORT:
            return self.merged(data)
        rank = self.ranks.get
        none = len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def merged(self, data: bytes) -> list[int]:
        """As leaf, with the places of each rank's pairs kept together."""
        rank, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 within a part
        before = list(range(-1, n))  # start of the part before
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            if (r := rank(data[i : i + 2])) is not None:
                places.setdefault(r, []).append(i)
        ranks = list(places)
        heapify(ranks)
        while ranks:
            own = heappop(ranks)
            waiting = sorted(places.pop(own))
            for k, i in enumerate(waiting):
                j = end[i]
                if not j or j >= n or rank(data[i : end[j]]) != own:
                    continue  # merged since with another
                stop = end[i] = end[j]
                end[j] = 0
                lower = False
                if stop < n:
                    before[stop] = i
                    if (r := rank(data[i : end[stop]])) is not None:
                        lower = r < own
                        if r not in places:
                            places[r] = []
                            heappush(ranks, r)
                        places[r].append(i)
                if (p := before[i]) >= 0 and (r := rank(data[p:stop])) is not None:
                    lower = lower or r < own
                    if r not in places:
                        places[r] = []
                        heappush(ranks, r)
                    places[r].append(p)
                if lower:  # a pair of lower rank comes first, then the rest of this rank
                    places[own] = waiting[k + 1 :]
                    heappush(ranks, own)
                    break
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return out

    def _stable(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            middle = self.leaf(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            fits_left = i == 0 or self.stable(left[i - 1], middle[0])
            fits_right = j == len(right) or self.stable(middle[-1], right[j])
            if fits_left and fits_right:
                return left[:i] + middle + right[j:]
            i = i if fits_left else max(0, len(left) - 4 * (len(left) - i))
            j = j if fits_right else min(len(right), 4 * j)

    def encode_bytes(self, data: bytes) -> list[int]:
        known: dict[bytes, list[int]] = {}

        def tree(part: bytes) -> list[int]:
            if len(part) <= LEAF:
                return self.leaf(part)
            out = known.get(part)
            if out is None:
                half = LEAF << ((len(part) - 1) // LEAF).bit_length() - 1  # equal runs have equal halves
                out = known[part] = self.join(tree(part[:half]), tree(part[half:]))
            return out

        return tree(data)

    def encode_match(self, match: str) -> bytes:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = self.encode_bytes(data) if whole is None else [whole]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.words.text(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= RUN:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


    def decoded(self, ids: pa.Array) -> pa.Array:
        return pa.array([self.decode(np.asarray(i.values).tolist() if i.is_valid else []) for i in ids], pa.binary())


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process; the ranks are read where the task runs."""
    return Codec(load_ranks(path), pattern)


def _appended(df: DataFrame, columns: dict[str, str], made: Callable[[Codec, pa.RecordBatch], list[pa.Array]], path: str, pattern: str) -> DataFrame:
    """df with columns (name to type) computed from SLICE rows at a time."""
    kept = df.drop(*columns)
    names = kept.columns
    schema = StructType([*kept.schema.fields, *(StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own = part.select(names)
                yield pa.RecordBatch.from_arrays([*own.columns, *made(c, part)], names=[*names, *columns])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """df with the ids of each text, an array of integers; with bytes_col, also what they decode to."""

    def made(c: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        data = [c.encode(t.as_py()) for t in part.column(text_col)]
        ends = np.cumsum([0] + [len(d) // 4 for d in data]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
        return [ids] if bytes_col is None else [ids, c.decoded(ids)]

    return _appended(df, {ids_col: "array<int>"} | ({bytes_col: "binary"} if bytes_col else {}), made, path, pattern)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give none."""
    return _appended(df, {bytes_col: "binary"}, lambda c, part: [c.decoded(part.column(ids_col))], path, pattern)


def ids_text(ids: Column) -> Column:
    return F.array_join(ids, " ")
