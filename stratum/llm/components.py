"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, Scratch

#: Edges from which on a node is heavy, and pieces that a heavy node's edges are dealt to.
HEAVY, PIECES = 256, 64


def _with_least(edges: DataFrame, least: DataFrame, heavy: DataFrame) -> DataFrame:
    """``edges`` (u, v) joined with ``least`` (u, m); a heavy node's edges meet copies of its row in many tasks."""
    piece = F.pmod(F.xxhash64("v"), F.lit(PIECES)).cast("int")
    dealt = edges.join(F.broadcast(heavy), "u", "left").select("u", "v", F.when(F.col("heavy"), piece).otherwise(0).alias("piece"))
    pieces = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    copies = least.join(F.broadcast(heavy), "u", "left").select("u", "m", F.explode(pieces).alias("piece"))
    return dealt.join(copies, ["u", "piece"]).drop("piece")


def _heavy(counted: DataFrame, edges: int) -> DataFrame:
    """(u, heavy) of the nodes with many of the ``edges``: at most ``BROADCAST_ROWS``, as no more can have that many."""
    return counted.where(F.col("n") > max(HEAVY, edges // BROADCAST_ROWS)).select("u", F.lit(True).alias("heavy"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges``: long columns a, b; order, repeats and loops don't matter, rows with a null are no
    edges, an empty table gives an empty result.  Each round replaces every edge by one to the
    smallest neighbour, so chains shrink geometrically.  Minima are combined before the shuffle,
    and the edges of a heavy node are dealt to ``PIECES`` tasks before they meet its minimum.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.write(e, f"{name}-0")
    rows = e.count()
    for k in range(1, max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"{name}-least-{k}")
        large = _with_least(both, least.select("u", "m"), _heavy(least, 2 * rows)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = scratch.write(large, f"{name}-large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least.select("u", "m"), _heavy(least, 2 * rows))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct(), f"{name}-{k}")
        for old in (f"{name}-{k - 1}", f"{name}-least-{k}", f"{name}-large-{k}"):
            scratch.drop(old)
        e = after
        rows, nodes = e.agg(F.count("*"), F.countDistinct("u")).first()
        if rows == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # every node has one parent, and no parent has a parent
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
