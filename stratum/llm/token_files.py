"""Token files of directly addressable codes.

An id is split into 8-bit chunks.  Level 0 holds the low chunk of every id and a bitmap that
says which ids go on; level 1 holds the next chunk of those, and so on.  A rank directory
(ones before each block of 512 bits) turns a position on one level into that on the next, so
any id is read with one look at each level and no block is decoded.

Layout of a file, little-endian: magic, documents, tokens, levels (4 x u64); document ids
(i64) and flags of null ids (u8); ends of the documents' tokens (u64); then for each level its
size (u64), chunks (u8), bitmap (padded to 64 bytes) and rank directory (u64), all padded to 8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, parts, read_bytes, ship, write_bytes
from .tokens import default_vocabulary, encoded

MAGIC, RANK_BITS = 0x3143_4144_4E4B_4F54, 512
FILE_TOKENS = 4 << 20


def _pad(data: bytes, to: int = 8) -> bytes:
    return data + bytes(-len(data) % to)


def encode_file(doc_ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    ids = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    ends = np.cumsum([len(t) for t in tokens], dtype=np.uint64)
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little").tobytes()
        bits = _pad(bits, RANK_BITS // 8)
        ones = np.bitwise_count(np.frombuffer(bits, np.uint64)).astype(np.uint64).reshape(-1, RANK_BITS // 64).sum(1)
        rank = np.concatenate(([0], np.cumsum(ones))).astype(np.uint64)
        levels.append(np.array([len(rest)], np.uint64).tobytes() + _pad((rest & np.uint32(255)).astype(np.uint8).tobytes()) + bits + rank.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(levels)], np.uint64).tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + _pad(bytes(d is None for d in doc_ids))
    return head + names + ends.tobytes() + b"".join(levels)


class TokenFile:
    """A file's content: whole documents, and any single token by its position."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n, levels = np.frombuffer(data, np.uint64, 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = 32
        names = np.frombuffer(data, np.int64, docs, at).tolist()
        at += 8 * docs
        null = data[at : at + docs]
        self.doc_ids = [None if z else d for d, z in zip(names, null, strict=True)]
        at += docs + -docs % 8
        self.ends = np.frombuffer(data, np.uint64, docs, at).astype(np.int64)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, np.uint64, 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            size = -(-n // RANK_BITS) * (RANK_BITS // 8)
            bits = np.frombuffer(data, np.uint8, size, at)
            rank = np.frombuffer(data, np.uint64, size * 8 // RANK_BITS + 1, at + size)
            at += size + rank.nbytes
            self.levels.append((chunks, bits, rank))

    def __getitem__(self, i: int) -> int:
        """The token at a position of the file."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, rank) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block, first = i // RANK_BITS, i // RANK_BITS * (RANK_BITS // 8)
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(rank[block]) + before
        return out

    def tokens(self) -> np.ndarray:
        """All tokens, in order."""
        out: np.ndarray | None = None
        for chunks, bits, _ in reversed(self.levels):
            level = chunks.astype(np.uint32)
            if out is not None:
                level[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = level
        return out if out is not None else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Encode all documents in ascending id order into files in ``folder``; returns the manifest.

    Manifest: (file, partition, number, docs, tokens); files in order of partition and number hold
    the documents in order.  Null ids come first, rows that share an id are ordered by their
    texts' hashes.  A null text is just the end id.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{number:06d}.dac"
            write_bytes(name, encode_file(ids, held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64())], ["file", "partition", "number", "docs", "tokens"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, tokens in encoded(batch.column(1), path, end_id):
                held.append(tokens)
                ids.append(names[row])
                size += len(tokens)
                if size >= FILE_TOKENS:
                    yield close()
                    number, held, ids, size = number + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    ordered = rows.repartitionByRange(parts(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    return ordered.mapInArrow(write, "file string, partition int, number int, docs long, tokens long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of a manifest."""
    spark = manifest.sparkSession
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(read_bytes(name))
                tokens, ends = file.tokens(), file.ends
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crc = [zlib.crc32(tokens[i:j].tobytes()) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the running sum over files is a small single-partition window
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return files.repartition(parts(spark), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Write the documents' token files in the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.write(write_token_files(docs, scratch.path("files"), **options), "manifest")
    return read_token_files(manifest)
