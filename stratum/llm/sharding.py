"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

#: Cells of the ring; a key lies in the cell of its hash, a virtual node at the end of its cell.
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Equal rows dealt out in one piece.
RUN = 10_000


def ring(shards: int, vnodes: int, seed: str = "ring") -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise; a shard's nodes don't depend on the others."""
    return sorted((int.from_bytes(hashlib.sha256(f"{seed}/{s}/{v}".encode()).digest()[:8], "big") >> (64 - CELL_BITS), s) for s in range(shards) for v in range(vnodes))


def deal(counts: dict[int, int], shards: int, vnodes: int = 64, slack: float = 0.0, seed: str = "ring") -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the keys of each cell go.

    A shard holds at most ``(1 + slack)`` times the mean, rounded up; without slack the
    capacities add up to the keys, so that shard counts differ by one at most.  Each virtual node
    first takes the keys of its own arc; what finds its shard full goes on clockwise to the next
    node whose shard has room.  Works on counts alone: at most ``CELLS`` numbers.
    """
    total = sum(counts.values())
    if slack > 0:
        room = [int(-(-total * (1 + slack) // shards))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    nodes, used, out = ring(shards, vnodes, seed), [0] * shards, []
    cells = deque(sorted((c, n) for c, n in counts.items() if n))
    own: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    k = 0
    for cell, n in cells:
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        own[k % len(nodes)].append((cell, 0, n))

    def take(shard: int, queue: deque) -> None:
        while queue and room[shard] > 0:
            cell, lo, hi = queue.popleft()
            n = min(hi - lo, room[shard])
            out.append((cell, lo, lo + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
            if lo + n < hi:
                queue.appendleft((cell, lo + n, hi))

    over = []
    for (_, shard), keys in zip(nodes, own, strict=True):
        queue = deque(keys)
        take(shard, queue)
        over.append(queue)
    carry: deque = deque()
    while carry or any(over):
        for k, (_, shard) in enumerate(nodes):
            take(shard, carry)
            carry.extend(over[k])
            over[k].clear()
    return out


def bounded_load_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, vnodes: int = 64, slack: float = 0.0, seed: str = "ring") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots count from 0 without gaps in each shard.

    ``size``: UTF-8 bytes of the text plus 1 (1 for null), ``text_crc32``: of the same bytes, of a
    very long text too.  A row's key on the ring is its id, checksum and size, so rows that share an
    id, or have none, spread like others; rows equal in all three are counted before the shuffle
    and dealt out again from their count, so any number of them costs no more than one.  An empty
    table gives an empty result; other columns are ignored, whatever their names.

    Only counts per ring cell (``CELLS`` at most, whatever the input) reach the driver, and the
    table of cells that goes back has a row for each cell and shard boundary, so it is as bounded
    and may be broadcast.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = keys.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("place", F.xxhash64("id", "size", "text_crc32"))
    scratch = Scratch(docs.sparkSession, "shards")
    keys = scratch.write(keys.withColumn("cell", F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int")), "keys")
    counts = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    cells = pd.DataFrame(deal(counts, shards, vnodes, slack, seed), columns=["cell", "lo", "hi", "shard", "base"])
    cells = docs.sparkSession.createDataFrame(cells, "cell int, lo long, hi long, shard int, base long")
    # the keys' ranks in their cell are runs from ``start`` on; a run that crosses a boundary is in two shards
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("place", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1))
    runs = keys.withColumn("start", F.coalesce(before, F.lit(0))).join(F.broadcast(cells), "cell").where("start < hi and start + n > lo")
    first, end = F.greatest("start", "lo"), F.least(F.col("start") + F.col("n"), F.col("hi"))
    runs = runs.select("id", "size", "text_crc32", "shard", (F.col("base") + first - F.col("lo")).alias("slot"), (end - first).alias("n"))
    many = runs.where(F.col("n") > RUN).select("id", "size", "text_crc32", "shard", F.explode(F.expr(f"transform(sequence(0, (n - 1) div {RUN}), i -> struct(slot + i * {RUN} as slot, least({RUN}, n - i * {RUN}) as n))")).alias("p"))
    many = many.select("id", "size", "text_crc32", "shard", "p.slot", "p.n").repartition("slot")
    out = runs.where(F.col("n") <= RUN).unionByName(many)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)).alias("slot"))
