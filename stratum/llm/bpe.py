"""Byte-level BPE by a file of ranks: segment-tree merges, and ids back to bytes.

A text is split by the vocabulary's pattern.  A split that is a token is that token; any other
starts as single bytes, and a segment tree over the byte positions holds, for each live part, the
rank of what it and its right neighbour would make.  Its root names the leftmost pair of the
smallest rank; a merge updates three leaves (the part, the part before it, the one that went), each
in logarithmic time, so a split of n bytes takes O(n log n) however long it is.

Distinct pieces of a block are encoded once, as in ``tokens``.  Their splits of up to 64 bytes go
through their trees together: a row of a matrix is a split's tree, and a step takes the root of each
row, merges there and updates the three leaves and what stands above them in all rows at once.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import ship
from .text import text_blocks
from .tokens import BLOCK_BYTES, Encoder, encoder

NO_PAIR = sys.maxsize


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def merged(piece: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of a split: pairs merged by smallest rank, the leftmost of equal ones first, until no pair has a rank."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    end, begin = list(range(1, n + 1)), list(range(-1, n))  # where the part from here ends; where the part up to here begins
    tree = [NO_PAIR] * (2 * n)

    def pair(i: int) -> int:
        """Rank of the part at ``i`` with the next one, and the place, as one number."""
        if (j := end[i]) == n or (rank := ranks.get(piece[i : end[j]])) is None:
            return NO_PAIR
        return rank * n + i

    def put(i: int, value: int) -> None:
        i += n
        tree[i] = value
        while i > 1:
            least = min(tree[i], tree[i ^ 1])
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = least

    for i in range(n):
        tree[n + i] = pair(i)
    for i in range(n - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while (first := tree[1]) != NO_PAIR:
        i = first % n
        gone = end[i]
        end[i] = end[gone]
        begin[end[i]] = i
        put(gone, NO_PAIR)
        put(i, pair(i))
        if i:
            put(begin[i], pair(begin[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Forest:
    """Trees of many splits side by side.  Ranks stand for the tokens, so they must differ and every byte must have one."""

    #: Leaves of a tree at most, a power of two; trees at once.
    WIDEST, TOGETHER = 64, 16_384

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        if len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token, and no two tokens may share a rank")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        get = ranks.get
        pairs = sorted((a << 32 | b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None)
        self.pairs, self.made = np.array([*(p for p, _ in pairs), NO_PAIR], np.int64), np.array([*(r for _, r in pairs), 0], np.int64)

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a leaf holds: the rank of the pair and the place as one number, or that there is none."""
        pair = left << 32 | right
        found = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[found] == pair, self.made[found] * self.WIDEST + at, NO_PAIR)

    def merged(self, splits: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all splits, end of each one's ids), of splits of up to ``WIDEST`` bytes, as ``merged`` gives them for those that aren't tokens themselves."""
        n, w = len(splits), max(8, 1 << (max(map(len, splits)) - 1).bit_length())
        size = np.fromiter(map(len, splits), np.int64, n)
        ids = np.zeros((n, w), np.int64)
        live = np.arange(w) < size[:, None]
        ids[live] = self.single[np.frombuffer(b"".join(splits), np.uint8)]
        end, begin = np.tile(np.arange(1, w + 1), (n, 1)), np.tile(np.arange(-1, w), (n, 1))
        tree = np.full((n, 2 * w), NO_PAIR)
        row, at = np.nonzero(live[:, 1:])
        tree[row, w + at] = self._key(ids[row, at], ids[row, at + 1], at)
        for i in range(w - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        row = np.arange(n)
        while len(row := row[tree[row, 1] != NO_PAIR]):
            rank, at = np.divmod(tree[row, 1], self.WIDEST)
            gone = end[row, at]
            after = end[row, gone]
            ids[row, at], end[row, at], begin[row, after], live[row, gone] = rank, after, at, False
            tree[row, w + gone] = NO_PAIR
            more = after < size[row]
            tree[row, w + at] = NO_PAIR
            tree[row[more], w + at[more]] = self._key(rank[more], ids[row[more], after[more]], at[more])
            before = begin[row, at]
            more = before >= 0
            tree[row[more], w + before[more]] = self._key(ids[row[more], before[more]], rank[more], before[more])
            up = w + np.stack([at, gone, np.where(more, before, at)])
            while up[0, 0] > 1:
                up >>= 1
                tree[row, up] = np.minimum(tree[row, 2 * up], tree[row, 2 * up + 1])
        return ids[live], np.cumsum(live.sum(1))


class RankEncoder(Encoder):
    """Encodes and decodes by a file of (base64 token, rank) lines; the pattern is the one that the file's tokens were made with."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code, self.dtype = ("H", np.uint16) if max(self.ranks.values()) < 1 << 16 else ("I", np.uint32)
        self.added = {}
        # Fixed value: the pattern of this vocabulary, with its classes of letters and numbers left open.
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
        self.words = regex.compile(self.pattern.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")).findall
        self.exact = None
        self.forest = Forest(self.ranks)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.token_size = np.zeros(tokens[-1][1] + 1, np.int64)
        self.token_size[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self._empty()

    def _splits(self, piece: bytes) -> list[str]:
        """A piece's splits by the pattern."""
        text = piece.decode()
        if max(piece) >= self.odd_from and self.odd(text):
            self.exact = self.exact or self._exact_split()
            return self.exact(text)
        if text[1:].isalpha() and text[0] == " ":
            return [text]
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in ",.":
            return [text[:-1], text[-1]]
        return self.words(text)

    def _learn(self, splits: Iterable[str]) -> None:
        """Put the ids of new splits with the known ones; those of a width go through their trees together."""
        waiting: dict[int, list[str]] = {}
        for split in splits:
            piece = split.encode()
            if (rank := self.ranks.get(piece)) is not None:
                self.known[split] = array(self.code, [rank]).tobytes()
            elif len(piece) > Forest.WIDEST:
                self.known[split] = array(self.code, merged(piece, self.ranks)).tobytes()
            else:
                waiting.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(split)
        for own in waiting.values():
            for k in range(0, len(own), Forest.TOGETHER):
                some = own[k : k + Forest.TOGETHER]
                ids, ends = self.forest.merged([s.encode() for s in some])
                data, ends = ids.astype(self.dtype).tobytes(), (ends * np.dtype(self.dtype).itemsize).tolist()
                self.known.update((s, data[i:j]) for s, i, j in zip(some, [0, *ends], ends, strict=False))

    def _encode_all(self, pieces: list[bytes]) -> list[bytes]:
        out = list(map(self.pieces.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        splits = [self._splits(pieces[k]) for k in new]
        self._learn({s for own in splits for s in own}.difference(self.known))
        known = self.known.__getitem__
        for k, own in zip(new, splits, strict=True):
            out[k] = b"".join(map(known, own))
        return out

    def _exact_split(self):  # noqa: ANN202
        """The pattern with the letters and numbers that the ``tiktoken`` library takes for such, asked of it by every code point."""
        import regex
        import tiktoken

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        pattern = self.pattern
        for name in "LN":
            known = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
            codes = np.frombuffer(bytes(known.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
            firsts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
            lasts = np.append(firsts[1:], len(codes)) - 1
            pattern = pattern.replace(f"{{{name}}}", "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[firsts].tolist(), codes[lasts].tolist(), strict=True)))
        return regex.compile(pattern).findall

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, end of each list's bytes) of lists of ids laid end to end."""
        ids = ids.astype(np.int64)
        size = self.token_size[ids]
        done = np.cumsum(size)
        at = np.repeat(self.token_at[ids] - (done - size), size)
        at += np.arange(len(at))
        return self.token_bytes[at], np.concatenate(([0], done))[ends]


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(docs: DataFrame, columns: Sequence[str] | None):  # noqa: ANN202
    return F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns))).alias("row")


def _encoded(docs: DataFrame, text_col: str, vocabulary: str | None, columns: Sequence[str] | None, back: bool) -> DataFrame:
    ship(docs.sparkSession)
    path = vocabulary or default_ranks()
    rows = docs.select(_rows(docs, columns), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([rows.schema["row"]]).add("ids", ArrayType(IntegerType()))
    if back:
        schema = schema.add("decoded", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, RankEncoder)
        for batch in batches:
            for at, buf, offs in text_blocks(batch.column(1), BLOCK_BYTES, 1 << 30):
                ids, ends = enc.encode_block(buf, offs)
                out = [batch.column(0).slice(at, len(ends)), _lists(pa.array(ids.astype(np.int32)), ends)]
                if back:
                    out.append(_binary(*enc.decode(ids, ends)))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, ids): the ids of every whole text, beside a struct of the row's own ``columns`` (all, if not named).

    ``vocabulary``: a rank file, by default ``byte_bpe_50k.tiktoken``.  Special tokens spelled in a
    text are ordinary text.  A null or empty text has no ids; a very long one is encoded whole, as
    a block of its own; rows that repeat are encoded each; an empty table gives an empty one.
    Other columns, of any name, sit in the struct, so none can clash.  Tasks are independent, and
    what one remembers of pieces is bounded.
    """
    return _encoded(docs, text_col, vocabulary, columns, back=False)


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, decoded): the bytes of each list of ids; a null list has no bytes, a null or unknown id in it raises."""
    ship(rows.sparkSession)
    path = vocabulary or default_ranks()
    rows = rows.select(_rows(rows, columns), F.coalesce(F.col(f"`{ids_col}`").cast("array<long>"), F.array().cast("array<long>")).alias("ids"))
    schema = StructType([rows.schema["row"]]).add("decoded", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, RankEncoder)
        for batch in batches:
            column = batch.column(1)
            ids = column.flatten()
            if ids.null_count:
                raise ValueError("a list of ids holds a null")
            ids = ids.to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(enc.token_size) or not enc.token_size[ids].all()):
                raise ValueError("a list holds an id that the vocabulary doesn't have")
            ends = column.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(*enc.decode(ids, ends[1:] - ends[0]))], schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, ids, decoded): ``encode``, and the bytes that the ids decode to, in one pass over the texts."""
    return _encoded(docs, text_col, vocabulary, columns, back=True)
