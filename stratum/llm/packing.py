"""Best-fit packing of documents into token sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, ship
from .tokens import default_vocabulary, encoded

#: Pieces packed together at most, and the fill below which a bin is packed again with other groups' bins.
GROUP, OPEN_FILL = 16_384, 0.97
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Bins of item numbers, largest items first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = cap, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], cap: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges from emptier to fuller underfull bins.

    Each step takes tokens from a bin to one that is at least as full, so the sum of squared
    fills grows strictly and the search ends; it stops early at the fewest bins that the total
    allows.  Emptied bins go.
    """
    full = [b for b in bins if sum(lengths[i] for i in b) == cap]
    under = [b for b in bins if sum(lengths[i] for i in b) < cap]
    fewest = -(-sum(lengths[i] for b in under for i in b) // cap)
    better = True
    while better and len(under) > fewest:
        better = False
        under.sort(key=lambda b: sum(lengths[i] for i in b))
        fill = [sum(lengths[i] for i in b) for b in under]
        for d in range(len(under)):
            for r in range(len(under) - 1, d, -1):
                step = _step(under[d], under[r], cap - fill[r], lengths) if fill[r] >= fill[d] and under[d] else None
                while step:
                    out, back = step
                    gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                    for i in out:
                        under[d].remove(i)
                        under[r].append(i)
                    for i in back:
                        under[r].remove(i)
                        under[d].append(i)
                    fill[d] -= gain
                    fill[r] += gain
                    better = True
                    step = _step(under[d], under[r], cap - fill[r], lengths) if under[d] else None
        under = [b for b in under if b]
    return full + under


def _step(donor: list[int], taker: list[int], room: int, lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """The exchange that fills ``taker`` most within ``room``: (items out of donor, items back)."""
    if not room:
        return None
    best, found = 0, None
    for x in donor:
        if best < lengths[x] <= room:
            best, found = lengths[x], ([x], [])
    if found:
        return found
    for y in taker:
        for k, x in enumerate(donor):
            gain = lengths[x] - lengths[y]
            if best < gain <= room:
                best, found = gain, ([x], [y])
            for z in donor[k + 1 :]:
                if best < gain + lengths[z] <= room:
                    best, found = gain + lengths[z], ([x, z], [y])
    return found


def pack(lengths: list[int], cap: int) -> list[list[int]]:
    return local_search(best_fit(lengths, cap), lengths, cap)


def _placed(rows: dict[str, list], cap: int, base: int) -> pa.RecordBatch:
    """A group's pieces with their places; ``open``: the bin has room to be packed again."""
    lengths = rows["length"]
    seq, off, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for b, items in enumerate(pack(lengths, cap)):
        at = 0
        for i in items:
            seq[i], off[i] = base + b, at
            at += lengths[i]
        free[items] = at < OPEN_FILL * cap
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([*(pa.array(rows[c], t) for c, t in types.items()), pa.array(seq), pa.array(off), pa.array(free)], [*types, "sequence_id", "offset", "open"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    Ids are those of byte-level BPE with none added (one that the text spells is kept), then ``end_id``.  A document of more
    than ``cap`` ids is cut into pieces of ``cap``, the first one shorter; no other is cut.

    Pieces are packed in groups of at most ``GROUP`` within the tasks that encode them, without a
    shuffle.  Bins that a group leaves less than ``OPEN_FILL`` full are dissolved and packed
    again across groups.  A null text is one end id; a null id stays null; rows that repeat are
    packed as often as they come; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary or default_vocabulary()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, group = (TaskContext.get().partitionId() + 1) << 36, 0
        held: dict[str, list] = {c: [] for c in columns}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in encoded(batch.column(1), path, end_id):
                cuts = [0, *range(len(tokens) % cap or cap, len(tokens) + 1, cap)]
                for piece, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if len(tokens) > cap else [(0, (0, len(tokens)))]:
                    for c, v in zip(columns, (ids[row], piece, i, j - i, zlib.crc32(tokens[i:j].tobytes())), strict=True):
                        held[c].append(v)
                if len(held["length"]) >= GROUP:
                    yield _placed(held, cap, base + (group << 20))
                    held, group = {c: [] for c in columns}, group + 1
        if held["length"]:
            yield _placed(held, cap, base + (group << 20))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, group = ((TaskContext.get().partitionId() + 1) << 36) | 1 << 60, 0
        held: dict[str, list] = {c: [] for c in columns}
        for batch in batches:
            for c in columns:
                held[c] += batch.column(batch.schema.get_field_index(c)).to_pylist()
            while len(held["length"]) >= GROUP:
                yield _placed({c: v[:GROUP] for c, v in held.items()}, cap, base + (group << 20))
                held, group = {c: v[GROUP:] for c, v in held.items()}, group + 1
        if held["length"]:
            yield _placed(held, cap, base + (group << 20))

    scratch = Scratch(spark, "packing")
    first = scratch.write(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")).mapInArrow(encode, PACKED + ", open boolean"), "first")
    loose = first.where("open").select(*columns)
    count = loose.count()
    repacked = loose.repartition(1 + count // GROUP, F.xxhash64("doc_id", "piece", "start")).mapInArrow(again, PACKED + ", open boolean")
    return first.where("not open").unionByName(repacked).drop("open")
