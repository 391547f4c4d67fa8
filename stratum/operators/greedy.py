"""Greedy cuts of ordered rows, a hot group over many tasks.

A greedy rule says where the part that begins at a row ends, from running sums alone.  Rows are dealt
to blocks by range of (group, order).  A group within one block is folded there as it streams by.  Of
a group over several blocks, each block finds for its rows where the part that would begin there
ends, and follows these jumps until they leave the block.  Only the rows that such jumps lead to can
be a block's first cut; their jumps are doubled, so that after as many rounds as the number of blocks
has binary digits the cuts are known that are reached from the group's first row.  Each block then
walks from its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block.
ROWS = 65_536
#: The end of a part that isn't finished.
NEVER = (1 << 62) - 1


@dataclass(frozen=True)
class Filled:
    """Parts hold ``most`` rows and a sum of ``limit`` at most; a row above the limit is an error."""

    limit: int
    most: int

    def ends(self, before: np.ndarray, through: np.ndarray, rows: int, left: int) -> np.ndarray:
        """Where the part from each of the first ``rows`` places ends, of running sums of these and the rows behind; ``left``: rows to the group's end."""
        if (wrong := through[:rows] - before[:rows]).size and wrong.max() > self.limit:
            raise ValueError(f"one input of size {wrong.max()} exceeds the limit {self.limit}")
        return np.minimum(np.searchsorted(through, before[:rows] + self.limit, "right"), np.arange(rows) + self.most)

    def needs(self, end: Column, total: Column, first: Column, before: Column) -> Column:
        """Whether a block that ends at place ``end`` and sum ``total`` needs a row behind it."""
        return (first < end + self.most) & (before <= total + self.limit)


@dataclass(frozen=True)
class Reached:
    """Parts end when their sum is ``least`` or more and their rows a multiple of ``group``; the last may stay unfinished."""

    least: int
    group: int

    def ends(self, before: np.ndarray, through: np.ndarray, rows: int, left: int) -> np.ndarray:
        at = np.arange(rows)
        full = np.maximum(np.searchsorted(through, before[:rows] + self.least), at)
        end = at + -(-(full - at + 1) // self.group) * self.group
        return np.where((full < len(through)) & (end <= left), end, NEVER)

    def needs(self, end: Column, total: Column, first: Column, before: Column) -> Column:
        return before < total + self.least


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the folder of ``spark.checkpoint.dir``, which driver and executors share."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="stratum-"))
    return df.checkpoint()


def parted(rows: DataFrame, by: str, order: str, size: str, rule: Filled | Reached, name: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``name``: the number of each row's part within its group, from 0; -1 in an unfinished one.

    ``order``: unique within a group; rows that tie are dealt in any order.  A null size is 0, null groups
    are one group, an empty table gives an empty one.  ``fold`` gives the same from rows whose partitions
    hold whole groups, sorted.  Up to ``ROWS`` rows it does all; beyond, the groups that lie in one block.
    """
    blocks = -(-rows.count() // ROWS)
    if blocks <= 1:
        return fold(rows.repartition(by).sortWithinPartitions(by, order))
    kind = rows.schema[by].dataType.simpleString()
    # the row sits in a struct, so that its names can't clash
    dealt = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(f"`{by}`").alias("key"), F.col(f"`{order}`").alias("at"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long")).alias("size"))
    dealt = cut(dealt.repartitionByRange(blocks, "key", "at").sortWithinPartitions("key", "at").withColumn("block", F.spark_partition_id()))
    sums = dealt.groupBy(F.col("key").alias("__k"), F.col("block").alias("__b")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    group, so_far = Window.partitionBy("__k"), Window.partitionBy("__k").orderBy("__b")
    # a group over several blocks has a row for each, two for each block at most in all: small enough to broadcast
    info = sums.withColumn("several", F.count("*").over(group)).where("several > 1")
    info = info.select("__k", "__b", "several", F.sum("n").over(group).alias("rows"), (F.sum("n").over(so_far) - F.col("n")).alias("first"), F.sum("n").over(so_far).alias("end"), (F.sum("s").over(so_far) - F.col("s")).alias("sum"), F.sum("s").over(so_far).alias("total"))
    info = cut(info)
    widest = info.agg(F.max("several")).first()[0]
    short = dealt.join(F.broadcast(info.select("__k").distinct()), F.col("key").eqNullSafe(F.col("__k")), "left_anti")
    short = fold(short.sortWithinPartitions("key", "at").select("row.*"))
    if widest is None:
        return short

    # places and running sums, and for each block the blocks before it that need some of its rows
    early, late = info.select("__k", F.col("__b").alias("target"), "end", "total"), info.select(F.col("__k").alias("k"), F.col("__b").alias("later"), "first", "sum")
    pairs = late.join(early, F.col("k").eqNullSafe(F.col("__k")) & (F.col("target") < F.col("later")) & rule.needs(F.col("end"), F.col("total"), F.col("first"), F.col("sum")))
    behind = pairs.groupBy("k", "later").agg(F.collect_list(F.struct("target", "end", "total")).alias("behind"))
    known = info.join(behind, F.col("__k").eqNullSafe(F.col("k")) & (F.col("__b") == F.col("later")), "left").select("__k", "__b", "first", "sum", "rows", "behind")
    within = Window.partitionBy("key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    long = dealt.join(F.broadcast(known), F.col("key").eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b"))).drop("__k", "__b")
    long = cut(long.withColumns({"place": F.count(F.lit(1)).over(within) - 1 + F.col("first"), "through": F.sum("size").over(within) + F.col("sum")}))
    others = F.filter(F.col("behind"), lambda b: rule.needs(b["end"], b["total"], F.col("place"), F.col("through") - F.col("size")))
    asked = long.select("key", "block", "place", "through", "size", "rows", F.explode(F.concat(F.array("block"), F.coalesce(F.transform(others, lambda b: b["target"]), F.array().cast("array<int>")))).alias("target"))

    def follow(t: pa.Table) -> pa.Table:
        """One row: where the part from each of the block's rows ends, and where the jumps from it leave the block."""
        place = t["place"].to_numpy()
        sort = np.argsort(place, kind="stable")
        through, size = t["through"].to_numpy()[sort], t["size"].to_numpy()[sort]
        n = int((t["block"].to_numpy() == t["target"].to_numpy()).sum())
        first = int(place.min())
        ends = rule.ends(through - size, through, n, t["rows"][0].as_py() - first).tolist()
        leaves = list(ends)
        for i in range(n - 1, -1, -1):
            if ends[i] < n:
                leaves[i] = leaves[ends[i]]
        to_place = lambda x: [v if v == NEVER else v + first for v in x]
        return pa.table({"k": t["key"].slice(0, 1), "target": t["target"].slice(0, 1), "first": [first], "ends": pa.array([to_place(ends)], pa.list_(pa.int64())), "leaves": pa.array([to_place(leaves)], pa.list_(pa.int64()))})

    jumps = cut(asked.groupBy("key", "target").applyInArrow(follow, f"k {kind}, target int, first long, ends array<bigint>, leaves array<bigint>"))

    # the places that jumps lead to, and each one's jump out of its block
    led = jumps.select("k", F.explode(F.array_distinct("leaves")).alias("entry")).distinct().unionByName(info.select(F.col("__k").alias("k"), F.lit(0).cast("long").alias("entry")).distinct())
    led = led.distinct().join(F.broadcast(info.select("__k", "__b", F.col("first").alias("lo"), "end")), F.col("k").eqNullSafe(F.col("__k")) & (F.col("entry") >= F.col("lo")) & (F.col("entry") < F.col("end"))).select("__k", "__b", "entry")
    hops = led.join(jumps, F.col("k").eqNullSafe(F.col("__k")) & (F.col("target") == F.col("__b"))).select("k", "entry", F.element_at("leaves", (F.col("entry") - F.col("first") + 1).cast("int")).alias("to"))
    hops, reached = cut(hops), cut(hops.where("entry = 0").select("k", "entry"))
    for _ in range(int(widest - 1).bit_length()):
        step = hops.select(F.col("k").alias("__k"), F.col("entry").alias("__e"), "to")
        more = reached.join(step, F.col("k").eqNullSafe(F.col("__k")) & (F.col("entry") == F.col("__e"))).select("k", F.col("to").alias("entry"))
        twice = hops.select("k", "entry", F.col("to").alias("mid")).join(step, F.col("k").eqNullSafe(F.col("__k")) & (F.col("mid") == F.col("__e"))).select("k", "entry", "to")
        reached, hops = cut(reached.union(more).distinct()), cut(twice)
    entries = reached.join(F.broadcast(info.select("__k", "__b", F.col("first").alias("lo"), "end")), F.col("k").eqNullSafe(F.col("__k")) & (F.col("entry") >= F.col("lo")) & (F.col("entry") < F.col("end"))).select("__k", "__b", "entry")
    walks = jumps.select("k", "target", "first", "ends").join(entries, F.col("k").eqNullSafe(F.col("__k")) & (F.col("target") == F.col("__b")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, block, first, ends, at in zip(*(batch.column(i) for i in range(5)), strict=True):
                ends, first, at, n = ends.values.to_numpy(), first.as_py(), at.as_py(), 0
                while at < first + len(ends):
                    end = int(ends[at - first])
                    for c, v in zip(out, (k.as_py(), block.as_py(), at, n, end == NEVER), strict=True):
                        c.append(v)
                    at, n = end, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["k", "block", "start", "n", "open"])

    starts = cut(walks.select("k", "target", "first", "ends", "entry").mapInArrow(walk, f"k {kind}, block int, start long, n int, open boolean"))
    # numbers go on from block to block; a row before its block's first cut belongs to the part that is open there
    counts = starts.groupBy("k", "block").agg(F.count("*").alias("cuts"), F.max("open").alias("open"))
    counts = info.select("__k", "__b").join(counts, F.col("__k").eqNullSafe(F.col("k")) & (F.col("__b") == F.col("block")), "left")
    base = counts.select("__k", "__b", (F.coalesce(F.sum("cuts").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"), F.coalesce(F.max("open").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("was_open"))
    starts = starts.select(F.col("k").alias("__k"), F.col("block").alias("__b"), "start", "n", "open")
    marked = long.join(starts, F.col("key").eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b")) & (F.col("place") == F.col("start")), "left").drop("__k", "__b")
    marked = marked.join(F.broadcast(base), F.col("key").eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b")))
    marked = marked.withColumns({"n": F.last("n", ignorenulls=True).over(within), "open": F.last("open", ignorenulls=True).over(within)})
    number = F.when(F.coalesce("open", "was_open"), -1).otherwise(F.col("base") + F.coalesce("n", F.lit(-1))).cast("int")
    return short.unionByName(marked.select("row", number.alias("number")).select("row.*", F.col("number").alias(name)))
